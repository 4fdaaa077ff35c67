"""Fixed thresholds and names, in one place."""

from __future__ import annotations

# Target selection, feature filters, modelling and checks.
MAX_MISSING_SHARE = 0.05
DEPENDENCY_THRESHOLD = -0.5
MIN_DEPENDENT_LINES = 5
MAX_DEPENDENT_SHARE = 0.90
MIN_EFFECT_SD = 0.15
MIN_EXPRESSION_SD = 0.0
MIN_PAIRS = 5
MIN_TRAIN_ROWS, MIN_EVAL_ROWS = 10, 5
RIDGE_ALPHAS = [1.0, 3.16, 10.0, 31.6, 100.0, 316.0, 1e3, 3162.0, 1e4, 31623.0, 1e5, 316228.0, 1e6]
MLP_ALPHAS = [1e-3, 1e-2, 1e-1]
PCA_COMPONENTS = 200
CV_FOLDS = 5
TEST_FRACTION = VAL_FRACTION = 0.15
VERDICT_MARGIN = 0.01
DISEASE_KEYWORD = "osteosarcoma"
MODEL_PREFIX = "ACH-"
LOOK = 50  # labels of an axis that are looked at
# Texts that a delimited file uses for a missing value.
NA_TOKENS = [
    "", "NA", "N/A", "n/a", "#N/A", "#N/A N/A", "#NA", "NULL", "null", "NaN", "nan", "-NaN", "-nan", "None", "<NA>",
    "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN",
]
# Fixed names: curated metadata columns, in order.
METADATA_COLUMNS = [
    "ModelID", "PatientID", "CellLineName", "StrippedCellLineName", "DepmapModelType", "OncotreeLineage", "OncotreePrimaryDisease",
    "OncotreeSubtype", "OncotreeCode", "Age", "Sex", "PrimaryOrMetastasis", "SampleCollectionSite", "PediatricModelType",
]
