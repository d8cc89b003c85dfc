"""Dimension tables of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Vessel types.
VESSELS = {
    1: "ICA_L", 2: "ICA_R", 3: "M1_L", 4: "M1_R", 5: "M2_L", 6: "M2_R", 7: "A1_L", 8: "A1_R",
    9: "A2_L", 10: "A2_R", 11: "AComm", 12: "M3_L", 13: "M3_R", 14: "VA_L", 15: "VA_R", 16: "BA",
    17: "P1_L", 18: "P1_R", 19: "P2_L", 20: "P2_R", 21: "PComm_L", 22: "PComm_R", 23: "OA_L", 24: "OA_R",
}

# Landmark (node) types.
LANDMARKS = {
    0: "Undefined", 1: "ICARoot_L", 2: "ICARoot_R", 3: "ICA/MCA/ACA_L", 4: "ICA/MCA/ACA_R",
    5: "A1/A2_L", 6: "A1/A2_R", 7: "M1/M2_L", 8: "M1/M2_R", 9: "OA/ICA_L", 10: "OA/ICA_R",
    11: "OA_L", 12: "OA_R", 13: "M2/M3_L", 14: "M2/M3_R", 15: "VARoot_L", 16: "VARoot_R",
    17: "BA/VA", 18: "PCA/BA", 19: "P1/P2/Pcomm_L", 20: "P1/P2/Pcomm_R", 21: "Pcomm/ICA_L", 22: "Pcomm/ICA_R",
}

# Vessel type by the landmark types of its two ends: (start, end, vessel).
END_RULES = [
    (1, 3, 1),
    (2, 4, 2),
    (3, 1, 1), (3, 5, 7), (3, 7, 3),
    (4, 2, 2), (4, 6, 8), (4, 8, 4),
    (5, 3, 7), (5, 6, 11), (5, 23, 9), (5, 99, 9),
    (6, 4, 8), (6, 5, 11), (6, 24, 10), (6, 99, 10),
    (7, 3, 3), (7, 13, 5), (7, 29, 5), (7, 99, 5),
    (8, 4, 4), (8, 14, 6), (8, 30, 6), (8, 99, 6),
    (9, 11, 23),
    (10, 12, 24),
    (11, 9, 23),
    (12, 10, 24),
    (13, 7, 5), (13, 25, 12), (13, 29, 5), (13, 99, 12),
    (14, 8, 6), (14, 26, 13), (14, 30, 6), (14, 99, 13),
    (15, 17, 14),
    (16, 17, 15),
    (17, 15, 14), (17, 16, 15), (17, 18, 16),
    (18, 17, 16), (18, 19, 17), (18, 20, 18),
    (19, 18, 17), (19, 21, 21), (19, 27, 19), (19, 99, 19),
    (20, 18, 18), (20, 22, 22), (20, 28, 20), (20, 99, 20),
    (21, 19, 21),
    (22, 20, 22),
    (23, 5, 9), (23, 23, 9), (23, 99, 9),
    (24, 6, 10), (24, 24, 10), (24, 99, 10),
    (25, 13, 12), (25, 25, 12), (25, 99, 12),
    (26, 14, 13), (26, 26, 13), (26, 99, 13),
    (27, 19, 19), (27, 27, 19), (27, 99, 19),
    (28, 20, 20), (28, 28, 20), (28, 99, 20),
    (29, 7, 5), (29, 13, 5), (29, 29, 5), (29, 99, 5),
    (30, 8, 6), (30, 14, 6), (30, 30, 6), (30, 99, 6),
]

# Anatomical groups; a vessel type may be in several.
GROUPS = {
    "proximal": [1, 2, 3, 4, 7, 8, 14, 15, 16, 17, 18],
    "distal": [5, 6, 9, 10, 12, 13, 19, 20],
    "distal_aca": [9, 10],
    "distal_mca": [5, 6, 12, 13],
    "distal_pca": [19, 20],
    "left": [1, 3, 5, 7, 9, 12, 14, 17, 19, 21, 23],
    "right": [2, 4, 6, 8, 10, 13, 15, 18, 20, 22, 24],
}

# Labels of the multi-class segmentation.
CLASS_LABELS = {
    0: "Background", 1: "BA", 2: "R-PCA", 3: "L-PCA", 4: "R-ICA", 5: "R-MCA", 6: "L-ICA", 7: "L-MCA",
    8: "R-Pcom", 9: "L-Pcom", 10: "Acom", 11: "R-ACA", 12: "L-ACA", 13: "3rd-A2",
}

# Circle flags by vessel type, front and back half.
RING_FRONT = {1: "ica_l", 2: "ica_r", 7: "a1_l", 8: "a1_r", 9: "a2_l", 10: "a2_r", 11: "acomm"}
RING_BACK = {17: "p1_l", 18: "p1_r", 19: "p2_l", 20: "p2_r", 21: "pcomm_l", 22: "pcomm_r"}


def end_rules() -> list[tuple[int, int, int]]:
    return END_RULES


def end_rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(end_rules(), "start_type int, end_type int, vestype int")


def group_table(spark: SparkSession) -> DataFrame:
    rows = [(g, v) for g, members in GROUPS.items() for v in members]
    return spark.createDataFrame(rows, "grp string, vestype int")


def sql_values(rows) -> str:
    """The rows of a dimension table as a SQL VALUES list."""
    def text(v):
        return "'" + v + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
