"""Values fixed by the data the engine works with; results depend on them as they stand."""

# Sets of the compound portal database that enter the dictionary.
DICTIONARY_SETS = ("28", "213", "408")
# Fixed value: origin of compound records that were computed rather than reported.
CALCULATED_ORIGIN = "calculated"
# Fixed value: attribute type that marks a synonym.
SYNONYM_ATTRIBUTE_TYPE = "3"
# Fixed value: the external database whose ids link a compound to the compound database.
EXTERNAL_COMPOUND_DB = 2
# Fixed value: the set whose own quality ranking is not trusted.
PORTAL_SET = "Chemical Probes.org"

# Prefixes of therapeutic-area ids, preferred one first.
AREA_FIRST = "OTAR_"
AREA_SECOND = ("MONDO_", "EFO_")

# Article types and their labels.
REVIEW = "Review"
LABEL_REVIEW = "review"
LABEL_PRIMARY = "primary"
DETAIL_REVIEW = "Review Article"
DETAIL_PRIMARY = "Primary Research / Other"
DETAIL_UNKNOWN = "ID Not Found"
DETAIL_NO_TITLE = "No Title Found"
DETAIL_NOT_AVAILABLE = "N/A"

# Article sections that are read as another section.
SECTION_NAMES = {
    "DISCUSS,CONCL": "DISCUSS",
    "title": "TITLE",
    "RESULTS,DISCUSS": "RESULTS",
}

# Combined disease tags and the single disease each stands for.
DISEASE_TAGS = {
    "NE,prostate cancer,CRPC": "NE",
    "cancer,HCC": "HCC",
    "MCC,tumors": "MCC",
    "leukemia,AML": "AML",
    "acute myeloid leukemia,AML": "AML",
    "tumor,AML": "AML",
    "ovarian cancer,cancer": "ovarian cancer",
    "cancer,ovarian cancer,tumor": "ovarian cancer",
    "tumor,ovarian cancer": "ovarian cancer",
    "leukemia,pancreatic cancer,neuroblastoma": "pancreatic cancer",
    "cancer,tumour": "cancer",
    "lymphoma,cancer,myeloma": "myeloma",
    "HCC,lymphoma,tumour": "HCC",
    "NASH,liver steatosis": "NASH",
    "tumor,MB": "MB",
}

# Disease names as written in articles and the name they are grounded by.
DISEASE_NAMES = {
    "NE": "prostate cancer",
    "UPEC infection": "infection",
    "HGSOC": "High-grade serous ovarian cancer",
    "lung cancercell": "lung cancer",
    "EOAD": "Alzheimer's disease",
    "ovarian cancer": "epithelial ovarian cancer",
    "melanoma tumor": "melanoma",
    "MB": "medulloblastoma",
    "OCCC": "ovarian clear cell adenocarcinoma",
}

# Fixed value: a gene that the grounding table lacks.
GENE_OVERRIDES = {"SLC2A1": "ENSG00000117394"}

# Fixed value: a term dropped from a disease list that names others too.
VAGUE_DISEASE = "defect"
