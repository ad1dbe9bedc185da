"""The main set is distinct because its sources are; its own wide rows are not grouped."""

from __future__ import annotations

import re

from conftest import rows

from litevidence.operators.dictionary import main_set
from litevidence.plans.catalog import SETS, portal
from litevidence.plans.views import Views

SF = "/root/testdata/sf0.001"


def test_combinations_are_not_grouped(spark, capsys):
    main_set(portal(Views(spark, SF)), SETS).explain()
    keys = re.findall(r"Aggregate\(keys=\[([^\]]*)\]", capsys.readouterr().out)
    assert keys and not any("INCHI" in k and ("gene_name" in k or "GENE" in k) for k in keys)


def test_copies_in_the_sources_count_once(spark):
    table = lambda data, schema: spark.createDataFrame(data, schema)
    tables = {
        # Two compounds of one name and structure, a probe without compound, a probe without control, copies.
        "probe": table(
            [(1, 10, "A", "o", "['c']"), (1, 11, "A", "o", "['c']"), (1, 10, "A", "o", "['c']"), (2, 99, "A", "o", None),
             (3, 10, "A", "calculated", "['c']"), (4, 10, "B", "o", "['c']")],
            "probeid long, compound_id long, compoundset_id string, origin_id string, control string",
        ),
        "compound": table([(10, "n", "k"), (11, "n", "k"), (11, "n", "k")], "compoundid long, name string, inchikey string"),
        "compoundset": table([("A", "set A"), ("A", "set A"), ("B", "set B")], "compoundsetid string, name string"),
        "probetobasetarget": table(
            [(1, 5), (1, 5), (1, 6), (2, 5), (2, 7), (3, 5), (4, 5), (1, None)], "probe_id long, basetarget_id long"
        ),
        "basetarget": table([(5, "['g']"), (5, "['g']"), (5, "['h']"), (6, None)], "basetargetid long, gene_name string"),
        # Two proteins with one accession, one target with two accessions, one with none.
        "targettobasetarget": table([(5, 20), (5, 21), (5, 22), (6, 20), (6, 23)], "basetarget_id long, target_id long"),
        "target": table([(20, "u"), (21, "u"), (22, "v"), (23, None)], "targetid long, uniprotid string"),
    }
    got = main_set(tables, ["A"]).select("ID", "SETID", "SET", "UNIPROT", "PROBE", "INCHI", "GENE", "CONTR", "TARGETID")
    probes = {1: ("n", "k", "c"), 2: (None, None, None)}
    wanted = [(1, u, None, 6) for u in ("u", None)] + [(i, u, [g], 5) for i in (1, 2) for u in ("u", "v") for g in ("g", "h")]
    expected = [(i, "A", "set A", u, *probes[i][:2], g, probes[i][2], t) for i, u, g, t in wanted]
    assert rows(got) == sorted(expected, key=repr)
