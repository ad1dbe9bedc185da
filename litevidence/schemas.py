"""Explicit schemas of every table the engine reads.

Text tables (TSV, CSV) declare strings only; typed tables are Parquet.
"""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_STRINGS = T.ArrayType(T.StringType())

# One row per entity found in a sentence, as delivered by the annotation service.
RAW_MATCHES = _struct(
    pmid=_S, label=_S, keywordId=_S, type=_S, pubDate=T.DateType(), section=_S, text=_S
)

PROBES_TEXT = _struct(
    SETID=_S, UNIPROT=_S, PROBE=_S, SET=_S, INCHI=_S, GENE=_S, CONTR=_S,
    COMPOUND_KEY=_S, PREF_NAME=_S, SYNOMS=_S, SYNOMS_TARGET=_S,
)

TRIPLETS = _struct(pmid=_S, date=T.DateType(), section=_S, CD=_S, GP=_S, DS=_S, sentence=_S)

EVIDENCE = _struct(
    datatypeId=_S, datasourceId=_S, diseaseId=_S, targetId=_S, score=_D, evidenceCount=_L
)

# `sourceId` is the partition column of the folder layout.
DATED_EVIDENCE = _struct(
    diseaseId=_S, targetId=_S, datasourceId=_S, curationYear=_I, publicationYear=_I, studyYear=_I,
    sourceId=_S,
)

DISEASE = _struct(id=_S, name=_S, therapeuticAreas=_STRINGS)

KNOWN_DRUG = _struct(drugId=_S, targetId=_S, diseaseId=_S, phase=_D, status=_S)

ARTICLE_TYPE = _struct(pmid=_S, pubtypes=_STRINGS, title=_S)

GENE_SYMBOL = _struct(symbol=_S, ensembl_id=_S)

DISEASE_BLACKLIST = _struct(diseaseId=_S)

RELEASE_DATES = _struct(PROBE=_S, DATE=_S)

CURATED = _struct(
    PMID=_S, PMCID=_S, TEXT=_S, SECTION=_S, TAR=_S, COMP=_S, LABEL1=_S, LABEL2=_S, PROBE=_S,
    GENE=_S, DISEASES=_S, DISEASE_FOUND=_S, CONTROL=_S, DOSAGE=_S,
)
