"""The queries of the catalogue as SQL over the test tables, for comparison with another engine."""

from __future__ import annotations

from itertools import combinations

from litevidence.constants import DISEASE_NAMES, DISEASE_TAGS

_CLASSES = {
    "tagged": "DISEASES IS NOT NULL", "untagged": "DISEASES IS NULL", "annotated": "DISEASE_FOUND IS NOT NULL",
    "dosed": "DOSAGE IS NOT NULL",
}
# Named parts: each may use those before it.
PARTS = {
    "mentions": """
        SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS pmid, p_name || ' ' || p_brand AS label,
               CASE l_returnflag WHEN 'A' THEN 'CD_' || l_partkey WHEN 'N' THEN 'GP_' || l_suppkey
                    ELSE 'DS_' || CAST(l_quantity AS INTEGER) END AS label_id,
               CASE WHEN l_tax > 0.07 THEN 'OG' WHEN l_returnflag = 'A' THEN 'CD'
                    WHEN l_returnflag = 'N' THEN 'GP' ELSE 'DS' END AS entity_type,
               CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date,
               o_orderstatus AS section, o_orderpriority AS sentence
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "synonym_rows": """
        SELECT 'CD_' || p_partkey AS COMPOUND_KEY,
               unnest([p_brand, p_name || ' ' || p_brand, p_type]) AS label
        FROM part WHERE p_brand = 'Brand#7'""",
    "label_id_table": """
        SELECT label, min(COMPOUND_KEY) AS COMPOUND_KEY, count(DISTINCT COMPOUND_KEY) AS n_ids
        FROM synonym_rows GROUP BY label""",
    "selected": """
        SELECT * FROM mentions WHERE pmid IN
            (SELECT pmid FROM mentions WHERE label IN (SELECT label FROM synonym_rows))""",
    "entities": """
        SELECT DISTINCT pmid, sentence, date, section, entity_type, label_id FROM mentions""",
    "triplets": """
        SELECT pmid, sentence, date, section, c.label_id AS CD, g.label_id AS GP, d.label_id AS DS
        FROM (SELECT * FROM entities WHERE entity_type = 'CD') c
        JOIN (SELECT * FROM entities WHERE entity_type = 'GP') g USING (pmid, sentence, date, section)
        JOIN (SELECT * FROM entities WHERE entity_type = 'DS') d USING (pmid, sentence, date, section)""",
    "genes": """
        SELECT DISTINCT 'CD_' || l_partkey AS COMPOUND_KEY, l_returnflag AS SETID,
               CASE WHEN s_acctbal < 0 THEN '[''ALT-' || s_suppkey || ''', ''' || s_name || ''']'
                    ELSE '[''' || s_name || ''']' END AS GENE,
               CASE WHEN s_acctbal < 0 THEN ['ALT-' || s_suppkey, s_name] ELSE [s_name] END AS symbols,
               'GP_' || l_suppkey AS true_id
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "ground": """
        SELECT COMPOUND_KEY, SETID, GENE, symbol, 'GP_' || s_suppkey AS ENS_ID
        FROM (SELECT *, unnest(symbols) AS symbol FROM genes) LEFT JOIN supplier ON symbol = s_name""",
    "accepted": """
        SELECT * FROM triplets WHERE (CD, GP) IN
            (SELECT (COMPOUND_KEY, ENS_ID) FROM ground WHERE ENS_ID IS NOT NULL)""",
    "evidence": """
        SELECT 'DS_' || CAST(l_quantity + 3 AS INTEGER) AS diseaseId, 'GP_' || l_suppkey AS targetId,
               l_returnflag AS datasourceId, lower(l_returnflag) AS datatypeId,
               round(avg(l_discount), 6) AS score, count(*) AS evidenceCount
        FROM lineitem GROUP BY ALL""",
    "with_evidence": """
        SELECT a.pmid, a.sentence, a.date, a.section, a.CD AS probeId, a.GP AS targetId,
               a.DS AS diseaseId, e.datasourceId, e.datatypeId, e.score, e.evidenceCount
        FROM accepted a LEFT JOIN evidence e ON a.DS = e.diseaseId AND a.GP = e.targetId""",
    "dated": """
        SELECT DISTINCT l_linestatus AS sourceId, 'DS_' || CAST(l_quantity AS INTEGER) AS diseaseId,
               'GP_' || l_suppkey AS targetId, l_returnflag AS datasourceId,
               year(o_orderdate) AS c, year(l_shipdate) AS p,
               CASE WHEN l_tax > 0.04 THEN year(l_shipdate) END AS s
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "lists": """
        SELECT diseaseId, targetId, datasourceId,
               string_agg(CAST(c AS VARCHAR), '|' ORDER BY c) AS allcurationYears,
               string_agg(CAST(p AS VARCHAR), '|' ORDER BY p) AS allpublicationYears,
               string_agg(CAST(s AS VARCHAR), '|' ORDER BY s) AS allstudyYears
        FROM dated GROUP BY ALL""",
    "sizes": "SELECT DISTINCT p_size AS n FROM part",
    "disease": """
        SELECT 'DS_' || n AS id, 'disease ' || n AS name,
               CASE WHEN n <> 43 THEN list_filter([
                   CASE WHEN n BETWEEN 34 AND 42 THEN 'GO_' || n END,
                   CASE WHEN n BETWEEN 1 AND 19 THEN 'MONDO_' || n END,
                   CASE WHEN n BETWEEN 12 AND 30 THEN 'OTAR_' || n END,
                   CASE WHEN n BETWEEN 15 AND 38 THEN 'EFO_' || n END], lambda x: x IS NOT NULL) END AS areas,
               CASE WHEN n BETWEEN 12 AND 30 THEN 'OTAR_' || n WHEN n <= 19 THEN 'MONDO_' || n
                    WHEN n <= 38 THEN 'EFO_' || n WHEN n <= 42 THEN 'GO_' || n END AS area
        FROM sizes WHERE n <= 44""",
    "best_drug": """
        SELECT diseaseId, targetId, drugId, phase, status FROM (
            SELECT 'DS_' || CAST(l_quantity AS INTEGER) AS diseaseId, 'GP_' || l_suppkey AS targetId,
                   'DR_' || l_partkey AS drugId, CAST(l_linenumber AS DOUBLE) AS phase,
                   l_linestatus AS status,
                   row_number() OVER (PARTITION BY l_quantity, l_suppkey
                       ORDER BY l_linenumber DESC, 'DR_' || l_partkey, l_linestatus) AS rn
            FROM lineitem) WHERE rn = 1""",
    "review": """
        SELECT CAST(o_orderkey AS VARCHAR) AS pmid,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'review'
                    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE 'primary' END AS articleType
        FROM orders""",
    "main_set": """
        SELECT DISTINCT p_partkey AS ID, p_type AS SETID, n_name AS UNIPROT,
               CASE WHEN p_size > 5 THEN p_name END AS PROBE, 'set ' || p_type AS "SET",
               CASE WHEN p_size > 5 THEN 'IK_' || p_partkey END AS INCHI,
               CASE WHEN s_acctbal < 0 THEN s_name || '|ALT' || s_suppkey ELSE s_name END AS GENE,
               p_brand AS CONTR, l_suppkey AS TARGETID
        FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey
             JOIN nation ON n_nationkey = s_nationkey
        WHERE p_brand NOT IN ('Brand#13', 'Brand#14') AND p_type IN ('ECONOMY', 'SMALL', 'MEDIUM')""",
    "attribute_synonyms": """
        SELECT ID, string_agg(v, '|' ORDER BY v) AS SYNOMS FROM (
            SELECT DISTINCT l_partkey AS ID, 'S' || l_linenumber AS v
            FROM lineitem JOIN part ON l_partkey = p_partkey
            WHERE l_linenumber IN (3, 5, 7) AND p_size > 5) GROUP BY ID""",
    "names": """
        SELECT 'IK_' || p_partkey AS INCHI, 'CD_' || p_partkey AS COMPOUND_KEY,
               CASE WHEN p_brand <> 'Brand#3' THEN p_name END AS PREF_NAME,
               CASE WHEN p_type <> 'SMALL' THEN least(p_brand, p_type) || '|' || greatest(p_brand, p_type)
                    END AS SYNOMS_DB
        FROM part WHERE p_size < 44""",
    "target_names": """
        SELECT s_suppkey AS TARGETID, least(n_name, r_name) || '|' || greatest(n_name, r_name) AS SYNOMS_TARGET
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "protein_names": """
        SELECT n_name AS UNIPROT, string_agg(s_name, '|' ORDER BY s_name) AS SYNOMS_TARGET_DB
        FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""",
    "enriched": """
        SELECT m.*, n.PREF_NAME, n.COMPOUND_KEY,
               array_to_string(list_sort(list_distinct(list_concat(
                   string_split(coalesce(a.SYNOMS, ''), '|'),
                   string_split(coalesce(n.SYNOMS_DB, ''), '|')))), '|') AS raw_syn,
               array_to_string(list_sort(list_distinct(list_concat(
                   string_split(coalesce(t.SYNOMS_TARGET, ''), '|'),
                   string_split(coalesce(p.SYNOMS_TARGET_DB, ''), '|')))), '|') AS raw_tar
        FROM main_set m LEFT JOIN attribute_synonyms a USING (ID) LEFT JOIN names n ON m.INCHI = n.INCHI
             LEFT JOIN target_names t ON m.TARGETID = t.TARGETID
             LEFT JOIN protein_names p ON m.UNIPROT = p.UNIPROT""",
    "merged": """
        SELECT * EXCLUDE (raw_syn, raw_tar), ltrim(raw_syn, '|') AS SYNOMS,
               ltrim(raw_tar, '|') AS SYNOMS_TARGET
        FROM enriched""",
    "gate_keys": """
        SELECT INCHI FROM main_set WHERE "SET" <> 'set MEDIUM'
        UNION SELECT 'IK_' || p_partkey FROM part WHERE p_size >= 25""",
    "gated": """
        SELECT m.* FROM main_set m SEMI JOIN gate_keys k ON m.INCHI IS NOT DISTINCT FROM k.INCHI""",
    "report": """
        SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS PMID, 'PMC_' || l_orderkey AS PMCID,
               p_name || ' ' || o_orderpriority AS TEXT,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Other' WHEN '2-HIGH' THEN 'RESULTS,DISCUSS'
                    WHEN '3-MEDIUM' THEN 'DISCUSS,CONCL' WHEN '4-NOT SPECIFIED' THEN 'title' END AS SECTION,
               p_name AS PROBE, 'GENE' || l_suppkey AS GENE,
               CASE WHEN l_linenumber IN (2, 4, 6) THEN NULL
                    WHEN l_linenumber = 1 THEN lower(p_type) || ',cancer'
                    WHEN l_linenumber = 3 THEN {tags}[l_partkey % {n_tags} + 1]
                    ELSE lower(p_type) || ' tumors' END AS DISEASES,
               CASE WHEN l_linenumber NOT IN (3, 6)
                    THEN '[''' || lower(p_brand) || ' cancer'', ''defect'', ''defects'']' END AS DISEASE_FOUND,
               CASE l_returnflag WHEN 'A' THEN 'C' || p_brand WHEN 'N' THEN 'Keyword' END AS CONTROL,
               CASE WHEN l_tax > 0.06 THEN 'IC50' END AS DOSAGE
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "flat_report": """
        SELECT * REPLACE (replace(regexp_replace(DISEASE_FOUND, '[]["'']', '', 'g'), ', ', '|')
                          AS DISEASE_FOUND) FROM report""",
    "named": """
        SELECT DISTINCT PMID, PROBE, GENE,
               CASE replace({by_tag}, 'tumors', 'tumor') {names} ELSE replace({by_tag}, 'tumors', 'tumor') END AS DISEASES
        FROM report""",
    "sides": """
        SELECT pmid, CD, GP, DS, section = 'F' AS gold FROM triplets""",
    "text_a": "SELECT DISTINCT text FROM documents WHERE lang = 'en'",
    "text_b": """
        SELECT DISTINCT text FROM documents
        WHERE lang <> 'en' OR doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "grounded": """
        SELECT DISTINCT PMID, c.CD, 'GP_' || substr(GENE, 5) AS GP, t.DS
        FROM named JOIN (SELECT p_name, min('CD_' || p_partkey) AS CD FROM part GROUP BY p_name) c ON PROBE = p_name
        JOIN (SELECT DISTINCT lower(p_type) || ' tumor' AS term, 'DS_' || length(p_type) AS DS FROM part) t
            ON DISEASES = t.term""",
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _cases(values: dict[str, str]) -> str:
    return " ".join(f"WHEN {_quoted(a)} THEN {_quoted(b)}" for a, b in values.items())


_TAGS = [*DISEASE_TAGS, *DISEASE_NAMES]
PARTS["report"] = PARTS["report"].replace("{tags}", f"[{', '.join(map(_quoted, _TAGS))}]").replace("{n_tags}", str(len(_TAGS)))
PARTS["named"] = (
    PARTS["named"].replace("{by_tag}", f"CASE DISEASES {_cases(DISEASE_TAGS)} ELSE DISEASES END").replace("{names}", _cases(DISEASE_NAMES))
)

_TRIPLET_COLUMNS = "pmid, sentence, date, section, CD, GP, DS"
_SLOTS = """
    SELECT {keys}, c.v AS CD, g.v AS GP, d.v AS DS
    FROM (SELECT DISTINCT {keys} FROM mentions) s
    LEFT JOIN (SELECT DISTINCT {keys}, {value} AS v FROM mentions WHERE entity_type = 'CD') c USING ({keys})
    LEFT JOIN (SELECT DISTINCT {keys}, {value} AS v FROM mentions WHERE entity_type = 'GP') g USING ({keys})
    LEFT JOIN (SELECT DISTINCT {keys}, {value} AS v FROM mentions WHERE entity_type = 'DS') d USING ({keys})"""
_FLAT = "coalesce(array_to_string({}, '|'), '')"

BODIES = {
    "dictionary_labels": "SELECT DISTINCT label FROM synonym_rows",
    "label_candidates": "SELECT * FROM label_id_table",
    "articles_with_probe": "SELECT * FROM mentions WHERE label IN (SELECT label FROM synonym_rows)",
    "article_mentions": "SELECT * FROM selected",
    "corpus_article_count": "SELECT count(DISTINCT pmid) AS n_articles FROM mentions",
    "improve_ids": """
        SELECT DISTINCT m.* REPLACE (coalesce(t.COMPOUND_KEY, m.label_id) AS label_id)
        FROM mentions m LEFT JOIN label_id_table t ON m.label = t.label""",
    "label_id_counts": """
        SELECT count(*) AS n_annotated, count(*) AS n_improved,
               count(*) FILTER (WHERE COMPOUND_KEY <> CASE l_returnflag WHEN 'A' THEN 'CD_' || l_partkey
                   WHEN 'N' THEN 'GP_' || l_suppkey ELSE 'DS_' || CAST(l_quantity AS INTEGER) END) AS n_changed
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
             LEFT JOIN label_id_table ON label = p_name || ' ' || p_brand""",
    "complete_mentions": """
        SELECT DISTINCT PMID, SECTION, PROBE, GENE, DISEASES, CONTROL, DOSAGE FROM report
        WHERE SECTION IS NOT NULL AND DISEASES IS NOT NULL AND CONTROL IS NOT NULL AND DOSAGE IS NOT NULL""",
    "triplet_extract": f"SELECT {_TRIPLET_COLUMNS} FROM triplets",
    "triplet_extract_outer": _SLOTS.format(keys="pmid, sentence, date, section", value="label_id"),
    "triplet_extract_labels": _SLOTS.format(keys="pmid, sentence", value="label"),
    "triplet_prevalence": """
        SELECT CD, GP, DS, count(*) AS n_triplets, count(DISTINCT pmid) AS n_articles
        FROM triplets GROUP BY ALL""",
    "gene_to_id": "SELECT COMPOUND_KEY, SETID, GENE, symbol, ENS_ID FROM ground",
    "accepted_pairs": f"""
        SELECT {_TRIPLET_COLUMNS}, SETID, GENE FROM triplets JOIN ground ON CD = COMPOUND_KEY AND GP = ENS_ID""",
    "accepted_pairs_once": f"SELECT {_TRIPLET_COLUMNS} FROM accepted",
    "blacklist_filter": f"""
        SELECT {_TRIPLET_COLUMNS} FROM triplets
        WHERE DS NOT IN (SELECT 'DS_' || p_size FROM part WHERE p_size >= 46)""",
    "attach_evidence": "SELECT * FROM with_evidence",
    "dated_evidence_lists": """
        SELECT * REPLACE (coalesce(allstudyYears, '') AS allstudyYears) FROM lists""",
    "attach_dated": """
        SELECT w.pmid, w.sentence, w.probeId, w.diseaseId, w.targetId, w.datasourceId,
               allcurationYears, allpublicationYears, allstudyYears
        FROM with_evidence w LEFT JOIN lists l
            ON w.diseaseId = l.diseaseId AND w.targetId = l.targetId AND w.datasourceId = l.datasourceId""",
    "temporal_precedence": """
        SELECT f.diseaseId, f.targetId, CAST(y AS INTEGER) AS literature_year,
               CAST(e AS INTEGER) AS evidence_year, y < e AS precedes
        FROM (SELECT DS AS diseaseId, GP AS targetId, min(year(CAST(date AS DATE))) AS y
              FROM triplets GROUP BY ALL) f
        LEFT JOIN (SELECT 'DS_' || CAST(l_quantity + 3 AS INTEGER) AS diseaseId, 'GP_' || l_suppkey AS targetId,
                          min(least(year(o_orderdate), year(l_shipdate))) AS e
                   FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                   WHERE l_returnflag <> 'R' GROUP BY ALL) g
            ON f.diseaseId = g.diseaseId AND f.targetId = g.targetId""",
    "therapeutic_areas": f"""
        SELECT pmid, sentence, date, section, CD, GP, DS AS diseaseId, name,
               {_FLAT.format("areas")} AS therapeuticAreas, area AS preferredArea
        FROM triplets LEFT JOIN disease ON DS = id""",
    "preferred_area": "SELECT id, area, area AS area_of_text FROM disease",
    "max_phase_drug": "SELECT * FROM best_drug",
    "attach_max_phase": """
        SELECT pmid, CD, DS AS diseaseId, GP AS targetId, drugId, phase, status
        FROM triplets LEFT JOIN best_drug ON DS = diseaseId AND GP = targetId""",
    "article_type": f"SELECT {_TRIPLET_COLUMNS}, articleType FROM triplets JOIN review USING (pmid)",
    "article_type_detail": """
        SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS pmid,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Review Article'
                    WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'Primary Research / Other'
                    ELSE 'ID Not Found' END AS classification,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Review'
                    WHEN '2-HIGH' THEN 'Journal Article, Systematic Review'
                    WHEN '3-MEDIUM' THEN 'Journal Article' WHEN '4-NOT SPECIFIED' THEN ''
                    ELSE 'N/A' END AS publication_types,
               CASE WHEN o_orderpriority IS NULL OR o_orderpriority = '5-LOW' THEN 'N/A'
                    WHEN o_totalprice > 100000 THEN 'Order of ' || o_custkey
                    ELSE 'No Title Found' END AS title
        FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
    "article_type_tally": """
        SELECT count(*) AS n_articles, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_reviews,
               count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS n_failed
        FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN orders ON l_orderkey = o_orderkey""",
    "compound_phase": """
        SELECT pmid, CD AS COMPOUND_KEY, CAST(floor(p_size / 10.0) AS INTEGER) AS max_phase
        FROM triplets LEFT JOIN part ON CD = 'CD_' || p_partkey""",
    "annotated_triplets": f"""
        WITH improved AS (
            SELECT DISTINCT pmid, sentence, date, section, entity_type,
                   coalesce(t.COMPOUND_KEY, m.label_id) AS label_id
            FROM selected m LEFT JOIN label_id_table t ON m.label = t.label),
        found AS (
            SELECT pmid, sentence, date, section, c.label_id AS CD, g.label_id AS GP, d.label_id AS DS
            FROM (SELECT * FROM improved WHERE entity_type = 'CD') c
            JOIN (SELECT * FROM improved WHERE entity_type = 'GP') g USING (pmid, sentence, date, section)
            JOIN (SELECT * FROM improved WHERE entity_type = 'DS') d USING (pmid, sentence, date, section))
        SELECT f.pmid, f.sentence, f.date, f.section, f.CD AS probeId, f.GP AS targetId,
               f.DS AS diseaseId, SETID AS setId, GENE AS gene, e.datasourceId, e.datatypeId, e.score,
               e.evidenceCount, allcurationYears, allpublicationYears, allstudyYears, o.name,
               {_FLAT.format("o.areas")} AS therapeuticAreas, o.area AS preferredArea,
               b.drugId, b.phase, b.status, r.articleType
        FROM found f JOIN ground ON CD = COMPOUND_KEY AND GP = ENS_ID
        LEFT JOIN evidence e ON f.DS = e.diseaseId AND f.GP = e.targetId
        LEFT JOIN lists l ON f.DS = l.diseaseId AND f.GP = l.targetId AND e.datasourceId = l.datasourceId
        LEFT JOIN disease o ON f.DS = o.id
        LEFT JOIN best_drug b ON f.DS = b.diseaseId AND f.GP = b.targetId
        LEFT JOIN review r ON f.pmid = r.pmid
        WHERE f.DS NOT IN (SELECT 'DS_' || p_size FROM part WHERE p_size >= 46)""",
    "probe_main_set": "SELECT * FROM main_set",
    "set_distinct_counts": "SELECT SETID, count(DISTINCT INCHI) AS n_compounds FROM main_set GROUP BY SETID",
    "compound_ids": "SELECT INCHI, COMPOUND_KEY FROM names",
    "structure_keys": "SELECT INCHI, COMPOUND_KEY FROM names",
    "external_ids": """
        SELECT p_partkey AS probeid, p_name AS name, 'IK_' || p_partkey AS inchikey,
               'L_' || p_partkey AS ligand_id
        FROM part WHERE p_size BETWEEN 17 AND 33 AND p_type IN ('ECONOMY', 'SMALL', 'MEDIUM')""",
    "probe_synonyms": "SELECT * FROM attribute_synonyms",
    "compound_synonyms": """
        SELECT INCHI, PREF_NAME, SYNOMS_DB FROM names""",
    "target_synonyms": "SELECT * FROM target_names",
    "component_synonyms": "SELECT * FROM protein_names",
    "synonym_merge": "SELECT * EXCLUDE (COMPOUND_KEY) FROM merged",
    "quality_gate": "SELECT * FROM gated",
    "probe_dictionary": """
        SELECT SETID, UNIPROT, PROBE, "SET", INCHI, GENE, CONTR, COMPOUND_KEY, PREF_NAME, SYNOMS, SYNOMS_TARGET
        FROM (SELECT DISTINCT * EXCLUDE (TARGETID) FROM merged) m
        SEMI JOIN gate_keys k ON m.INCHI IS NOT DISTINCT FROM k.INCHI""",
    "assay_units": """
        SELECT DISTINCT l_returnflag AS units, 'assay ' || o_orderstatus AS assay_desc
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount <> 0""",
    "known_articles": """
        SELECT CAST(o_orderkey AS VARCHAR) AS pmid, o_custkey AS doc_id, 'DOC_' || o_orderkey AS document_key
        FROM orders WHERE o_totalprice > 200000
            AND CAST(o_orderkey AS VARCHAR) IN (SELECT pmid FROM mentions)""",
    "documented_articles": """
        SELECT CAST(o_orderkey AS VARCHAR) AS pmid FROM orders WHERE o_totalprice > 200000""",
    "any_disease_rows": "SELECT * FROM report WHERE DISEASES IS NOT NULL OR DISEASE_FOUND IS NOT NULL",
    "subset_semi_chain": """
        SELECT * FROM flat_report
        WHERE SECTION IS DISTINCT FROM 'Other'
            AND PROBE IN (SELECT p_name FROM part WHERE p_brand = 'Brand#7')
            AND PMID IN (SELECT PMID FROM report WHERE DOSAGE IS NOT NULL)
            AND PMID IN (SELECT PMID FROM report WHERE starts_with(CONTROL, 'C'))""",
    "unique_triples": """
        SELECT PMID, GENE, PROBE, DISEASE, DISEASE_TYPE FROM (
            SELECT *, row_number() OVER (PARTITION BY PMID, GENE, PROBE
                ORDER BY DISEASE_TYPE DESC, DISEASE NULLS LAST) AS rn
            FROM (SELECT PMID, GENE, PROBE,
                         CASE WHEN DISEASES IS NULL THEN 'full_text' ELSE 'sentence' END AS DISEASE_TYPE,
                         coalesce(DISEASES, replace(DISEASE_FOUND, '|defect|', '|')) AS DISEASE
                  FROM flat_report)) WHERE rn = 1""",
    "first_per_article": """
        SELECT PMID, TEXT, PROBE, GENE FROM (
            SELECT *, row_number() OVER (PARTITION BY PMID ORDER BY TEXT, PROBE, GENE) AS rn
            FROM report WHERE SECTION IS DISTINCT FROM 'Other') WHERE rn = 1""",
    "clean_term_list": """
        SELECT DISTINCT r.DISEASE_FOUND, trim(r.DISEASE_FOUND, '[]''') AS stripped,
               f.DISEASE_FOUND AS flat, replace(f.DISEASE_FOUND, '|', '; ') AS items
        FROM (SELECT DISTINCT DISEASE_FOUND FROM report) r
        LEFT JOIN (SELECT DISTINCT DISEASE_FOUND FROM flat_report) f
            ON replace(regexp_replace(r.DISEASE_FOUND, '[]["'']', '', 'g'), ', ', '|') = f.DISEASE_FOUND""",
    "normalise_terms": "SELECT * FROM named WHERE DISEASES IS NOT NULL",
    "term_grounding": """
        SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'ONT_HH'
               ELSE 'ONT_' || substr(c_mktsegment, 1, 3) END AS DISEASE_ID FROM customer""",
    "fuzzy_grounding": """
        WITH free AS (
            SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ' ' || upper(p_name || ' ' || lower(p_type))
                WHEN 1 THEN replace(p_name, 'i', '') || ' ' || lower(p_type) WHEN 2 THEN lower(p_type) || ' ' || p_name
                WHEN 3 THEN p_name || 's of the ' || lower(p_type) || ' family'
                WHEN 4 THEN 'matter no. ' || p_partkey END AS TERM FROM part),
        known AS (
            SELECT DISTINCT p_name || ' ' || lower(p_type) AS name, 1 AS rank,
                   'FAM_' || replace(p_name, ' ', '-') || '-' || lower(p_type) AS id FROM part
            UNION SELECT DISTINCT p_name, 2, 'FAM_' || replace(p_name, ' ', '-') FROM part),
        asked AS (SELECT DISTINCT lower(trim(TERM)) AS name FROM free WHERE TERM IS NOT NULL),
        grams AS (
            SELECT DISTINCT side, name, substr('  ' || name || ' ', i, 3) AS gram
            FROM (SELECT side, name, unnest(range(1, length(name) + 2)) AS i
                  FROM (SELECT 'known' AS side, name FROM known UNION ALL SELECT 'asked', name FROM asked))),
        frequency AS (SELECT gram, count(*) AS df FROM grams WHERE side = 'known' GROUP BY gram),
        weights AS (
            SELECT gram, CAST(pow(floor(100 * ln(1 + (SELECT count(DISTINCT name) FROM known) / greatest(coalesce(df, 1), 1))), 2) AS BIGINT) AS square
            FROM (SELECT DISTINCT gram FROM grams) LEFT JOIN frequency USING (gram)),
        norms AS (SELECT side, name, CAST(sum(square) AS DOUBLE) AS norm FROM grams JOIN weights USING (gram) GROUP BY ALL),
        dots AS (
            SELECT x.name AS asked, y.name AS known, CAST(sum(square) AS DOUBLE) AS dot
            FROM (SELECT * FROM grams WHERE side = 'asked') x JOIN (SELECT * FROM grams WHERE side = 'known') y USING (gram)
                 JOIN weights USING (gram) GROUP BY ALL),
        hits AS (
            SELECT asked, id, dot * dot / (a.norm * b.norm) AS s2,
                   row_number() OVER (PARTITION BY asked ORDER BY dot * dot / (a.norm * b.norm) DESC, rank, known, id) AS rn
            FROM dots JOIN norms a ON a.side = 'asked' AND a.name = asked JOIN norms b ON b.side = 'known' AND b.name = known
                 JOIN known k ON k.name = known
            WHERE dot * dot / (a.norm * b.norm) >= 0.8::DOUBLE * 0.8::DOUBLE)
        SELECT p_partkey, TERM, id AS DISEASE_ID, round(sqrt(s2), 6) AS cosine
        FROM free LEFT JOIN hits ON lower(trim(TERM)) = asked AND rn = 1""",
    "coverage_by_bitmap": " UNION ALL ".join(
        f"SELECT '{'+'.join(own)}' AS \"union\", count(DISTINCT (PMID, GENE, PROBE)) AS n FROM report WHERE "
        + " OR ".join(_CLASSES[c] for c in own)
        for k in range(1, 5) for own in combinations(_CLASSES, k)
    ),
    "merged_export": "SELECT * FROM report",
    "drifted_folders": """
        SELECT l_linestatus AS sourceId, 'DS_' || CAST(l_quantity AS INTEGER) AS diseaseId, 'GP_' || l_suppkey AS targetId,
               l_returnflag AS datasourceId, year(o_orderdate) AS curationYear,
               CAST(year(l_shipdate) AS VARCHAR) AS publicationYear,
               CASE WHEN l_linestatus = 'O' AND l_tax > 0.04 THEN year(l_shipdate) END AS studyYear,
               CASE WHEN l_linestatus = 'F' THEN year(o_orderdate) END AS extra
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "text_round_trip": """
        SELECT CASE WHEN o_orderkey % 20 = 0 THEN 'too few fields' WHEN o_orderkey % 10 = 0 THEN 'a value of another type'
                    ELSE 'good' END AS kind, CAST(o_orderkey AS VARCHAR) AS pmid,
               CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority || chr(9) || '"quoted"' || chr(10) || 'next, ' || o_orderstatus END AS note
        FROM orders""",
    "pivot_in_blocks": """
        WITH cells AS (
            SELECT l_suppkey AS GENE, 'CD' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS PROBE, count(DISTINCT l_orderkey) AS n
            FROM lineitem GROUP BY ALL),
        column_ids AS (SELECT PROBE, row_number() OVER (ORDER BY PROBE) - 1 AS id FROM (SELECT DISTINCT PROBE FROM cells)),
        held AS (SELECT GENE, id // 256 AS block, id % 256 AS place, n FROM cells JOIN column_ids USING (PROBE)),
        grid AS (SELECT GENE, block, unnest(range(256)) AS place FROM (SELECT DISTINCT GENE, block FROM held))
        SELECT GENE, block, string_agg(coalesce(CAST(n AS VARCHAR), '-'), ' ' ORDER BY place) AS shown, any_value(PROBE) AS first_column
        FROM grid LEFT JOIN held USING (GENE, block, place) JOIN column_ids ON id = block * 256 GROUP BY GENE, block""",
    "article_sketch": """
        SELECT section, count(DISTINCT pmid) AS n, true AS within FROM mentions GROUP BY section
        UNION ALL SELECT 'all', count(DISTINCT pmid), true FROM mentions""",
    "label_grounding": """
        SELECT CASE WHEN s_acctbal < 0 THEN 'SLC2A1' ELSE s_name END AS GENE,
               CASE WHEN s_acctbal < 0 THEN 'ENSG00000117394' ELSE 'GP_' || s_suppkey END AS GENE_ID
        FROM supplier""",
    "release_dates": """
        SELECT 'CD_' || l_partkey AS PROBE, strftime(min(l_shipdate), '%b') AS DATE_MONTH,
               strftime(min(l_shipdate), '%y') AS DATE_YEAR,
               strftime(min(l_shipdate), '%Y-%m-01') AS RELEASED
        FROM lineitem GROUP BY l_partkey""",
    "pair_release_dates": """
        SELECT PROBE, GENE, n_articles, strftime(d, '%b') AS DATE_MONTH, strftime(d, '%y') AS DATE_YEAR,
               strftime(d, '%Y-%m-01') AS RELEASED
        FROM (SELECT CD AS PROBE, GP AS GENE, count(DISTINCT pmid) AS n_articles FROM triplets GROUP BY ALL)
        LEFT JOIN (SELECT 'CD_' || l_partkey AS id, min(l_shipdate) AS d FROM lineitem GROUP BY l_partkey)
            ON PROBE = id""",
    "probe_profile": """
        SELECT a.PROBE, a.INCHI, n.COMPOUND_KEY, CAST(floor(p.p_size / 10.0) AS INTEGER) AS MAX_PHASE,
               strftime(d, '%b') AS DATE_MONTH, strftime(d, '%y') AS DATE_YEAR,
               strftime(d, '%Y-%m-01') AS RELEASED
        FROM (SELECT p_name AS PROBE, min(CASE WHEN p_size > 5 THEN 'IK_' || p_partkey END) AS INCHI
              FROM part GROUP BY p_name) a
        LEFT JOIN names n ON a.INCHI = n.INCHI LEFT JOIN part p ON n.COMPOUND_KEY = 'CD_' || p.p_partkey
        LEFT JOIN (SELECT p_name, min(l_shipdate) AS d FROM lineitem JOIN part ON l_partkey = p_partkey
                   GROUP BY p_name) r ON r.p_name = a.PROBE""",
    "export_shape": """
        SELECT DISTINCT PROBE AS CD, GENE AS GP, coalesce(DISEASES, 'None') AS DS,
               coalesce(CONTROL, 'None') AS CONTR FROM report""",
    "corpus_profile": """
        SELECT count(*) AS n_rows, count(DISTINCT PMID) AS n_articles, count(DISTINCT TEXT) AS n_sentences,
               count(DISTINCT PROBE) AS n_probes, count(DISTINCT (PROBE, GENE)) AS n_pairs,
               count(DISTINCT (CONTROL, DOSAGE)) FILTER (WHERE CONTROL IS NOT NULL AND DOSAGE IS NOT NULL)
                   AS n_control_pairs
        FROM report""",
    "disease_coverage": """
        SELECT count(DISTINCT (PMID, GENE, PROBE)) AS n_all,
               count(DISTINCT (PMID, GENE, PROBE)) FILTER (WHERE DISEASES IS NOT NULL) AS n_tagged,
               count(DISTINCT (PMID, GENE, PROBE)) FILTER (WHERE DISEASES IS NULL) AS n_untagged,
               count(DISTINCT (PMID, GENE, PROBE)) FILTER (WHERE DISEASE_FOUND IS NOT NULL) AS n_annotated
        FROM report""",
    "section_counts": """
        SELECT CASE SECTION WHEN 'RESULTS,DISCUSS' THEN 'RESULTS' WHEN 'DISCUSS,CONCL' THEN 'DISCUSS'
                    WHEN 'title' THEN 'TITLE' ELSE SECTION END AS SECTION, count(*) AS n_sentences
        FROM report WHERE SECTION IS NOT NULL GROUP BY ALL""",
    "control_classes": """
        SELECT CASE WHEN CONTROL IS NULL THEN 'none' WHEN CONTROL = 'Keyword' THEN 'keyword'
                    ELSE 'name' END AS control_class, count(DISTINCT PMID) AS n_articles
        FROM report GROUP BY ALL""",
    "pair_article_counts": """
        SELECT PROBE, GENE, count(DISTINCT PMID) AS n_articles FROM report GROUP BY ALL
        ORDER BY n_articles, PROBE, GENE""",
    "pair_pivot": "SELECT l_suppkey AS GENE, "
    + ", ".join(
        f"nullif(count(DISTINCT l_orderkey) FILTER (WHERE p_brand = 'Brand#{i}'), 0) AS B{i}"
        for i in range(1, 26)
    )
    + ", CAST(NULL AS BIGINT) AS other FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey",
    "disease_gene_pivot": "SELECT DISEASES, "
    + ", ".join(f"avg(n) FILTER (WHERE s_nationkey = {i}) AS F{i}" for i in range(25))
    + """, CAST(NULL AS DOUBLE) AS other
        FROM (SELECT lower(p_type) AS DISEASES, s_nationkey, l_suppkey, count(DISTINCT l_orderkey) AS n
              FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
        GROUP BY DISEASES""",
    "disease_histogram": """
        SELECT PROBE, GENE, string_agg(item, ', ' ORDER BY item) AS all_diseases,
               CAST(sum(n) AS BIGINT) AS n_articles
        FROM (SELECT PROBE, GENE, DISEASES || '[' || count(*) || ']' AS item, count(*) AS n
              FROM named WHERE DISEASES IS NOT NULL GROUP BY PROBE, GENE, DISEASES) GROUP BY PROBE, GENE""",
    "gene_disease_counts": """
        SELECT GENE, DISEASES, count(*) AS n_articles FROM report WHERE DISEASES IS NOT NULL GROUP BY ALL""",
    "top_k_terms": """
        SELECT term, count(*) AS n FROM (SELECT unnest(string_split(DISEASES, ',')) AS term FROM report
            WHERE DISEASES IS NOT NULL) GROUP BY term ORDER BY n DESC, term LIMIT 10""",
    "entity_listing": """
        SELECT "SET", string_agg(PROBE, ', ' ORDER BY PROBE) AS probes
        FROM (SELECT DISTINCT p_brand AS "SET", p_name AS PROBE FROM part) GROUP BY "SET" """,
    "compare_triplets": """
        SELECT CD, GP, x.pmid AS pmid_x, x.DS AS DS_x, y.pmid AS pmid_y, y.DS AS DS_y
        FROM (SELECT * FROM sides WHERE NOT gold) x JOIN (SELECT * FROM sides WHERE gold) y USING (CD, GP)""",
    "pair_agreement": """
        SELECT CD, GP, count(DISTINCT x.i) AS n_extracted, count(DISTINCT y.i) AS n_curated,
               count(*) FILTER (WHERE x.DS = y.DS) AS n_same_disease, count(*) AS n_pairs
        FROM (SELECT *, row_number() OVER () AS i FROM sides WHERE NOT gold) x
        JOIN (SELECT *, row_number() OVER () AS i FROM sides WHERE gold) y USING (CD, GP)
        GROUP BY ALL""",
    "sentence_overlap": """
        SELECT count(*) FILTER (WHERE b.text IS NULL) AS only_first,
               count(*) FILTER (WHERE a.text IS NULL) AS only_second,
               count(*) FILTER (WHERE a.text = b.text) AS both
        FROM text_a a FULL JOIN text_b b ON a.text = b.text""",
    "sentences_common": "SELECT * FROM text_a INTERSECT SELECT * FROM text_b",
    "sentences_only_first": "SELECT * FROM text_a EXCEPT SELECT * FROM text_b",
    "sentences_only_second": "SELECT * FROM text_b EXCEPT SELECT * FROM text_a",
    "grounded_comparison": """
        SELECT CD, GP, x.pmid AS pmid_x, x.DS AS DS_x, y.PMID AS pmid_y, y.DS AS DS_y
        FROM triplets x JOIN grounded y USING (CD, GP)""",
    "grounded_histogram": """
        SELECT CD, GP, string_agg(item, ', ' ORDER BY item) AS all_diseases, CAST(sum(n) AS BIGINT) AS n_articles
        FROM (SELECT CD, GP, DS || '[' || count(*) || ']' AS item, count(*) AS n FROM grounded GROUP BY CD, GP, DS)
        GROUP BY CD, GP""",
}
BODIES["synonym_members"] = """
    SELECT 'probe' AS source, CAST(ID AS VARCHAR) AS key, unnest(string_split(SYNOMS, '|')) AS term FROM attribute_synonyms
    UNION ALL SELECT DISTINCT 'structure', INCHI, unnest(string_split(SYNOMS_DB, '|')) FROM names WHERE SYNOMS_DB IS NOT NULL
    UNION ALL SELECT 'target', CAST(TARGETID AS VARCHAR), unnest(string_split(SYNOMS_TARGET, '|')) FROM target_names
    UNION ALL SELECT 'protein', UNIPROT, unnest(string_split(SYNOMS_TARGET_DB, '|')) FROM protein_names"""
BODIES["article_mentions_pruned"] = BODIES["article_mentions"]
BODIES["triplet_extract_bucketed"] = BODIES["triplet_extract"]
BODIES["attach_evidence_bucketed"] = BODIES["attach_evidence"]
BODIES["frequent_terms"] = BODIES["top_k_terms"]
BODIES["prevalence_in_batches"] = BODIES["triplet_prevalence"]
BODIES["triplet_extract_split"] = BODIES["triplet_extract"]
BODIES["triplet_outer_split"] = BODIES["triplet_extract_outer"]
BODIES["compare_triplets_split"] = BODIES["compare_triplets"]
BODIES["dated_folder_lists"] = BODIES["dated_evidence_lists"]


def _uses(body: str) -> list[str]:
    """Names of the parts a query needs, directly or through other parts, in order."""
    words = set(body.replace("(", " ").replace(")", " ").replace(",", " ").split())
    needed: set[str] = {name for name in PARTS if name in words}
    for name in reversed(PARTS):
        if name in needed:
            needed |= set(_uses(PARTS[name]))
    return [name for name in PARTS if name in needed]


def _full(body: str) -> str:
    parts = ",\n".join(f"{name} AS ({PARTS[name]})" for name in _uses(body))
    if not parts:
        return body
    if body.lstrip().startswith("WITH "):
        return f"WITH {parts},\n{body.lstrip()[5:]}"
    return f"WITH {parts}\n{body}"


ORACLES = {name: _full(body) for name, body in BODIES.items()}
