"""Fixed values shared by the derived tables: rules, filters, element list (expressions both engines read)."""

from __future__ import annotations

SERIES_TAG_NAMES = [(1, "A"), (2, "N"), (3, "R")]
SERIES_TYPE_NAMES = [(1, "ECONOMY"), (2, "LARGE"), (3, "MEDIUM"), (4, "PROMO"), (5, "SMALL"), (6, "STANDARD")]

# path, value representation, expression over one wide image row (null = absent)
ELEMENTS: list[tuple[str, str, str]] = [
    ("(0002,0010)", "UI", "CASE WHEN stationName = 'S0' THEN '1.2.840.10008.1.2' WHEN stationName = 'S1' THEN "
                          "'1.2.840.10008.1.2.4.90' ELSE '1.2.840.10008.1.2.1' END"),
    ("(0008,0008)", "CS", "imageType"),
    ("(0008,0016)", "UI", "CASE WHEN modality = 'F' THEN '1.2.840.10008.5.1.4.1.1.2' WHEN modality = 'O' THEN "
                          "'1.2.840.10008.5.1.4.1.1.4' ELSE '1.2.840.10008.5.1.4.1.1.7' END"),
    ("(0008,0018)", "UI", "sopInstanceUID"),
    ("(0008,0020)", "DA", "studyDate"),
    ("(0008,0021)", "DA", "seriesDate"),
    ("(0008,0050)", "SH", "accessionNumber"),
    ("(0008,0060)", "CS", "modality"),
    ("(0008,0070)", "LO", "manufacturer"),
    ("(0008,0080)", "LO", "'Clinic ' || patientID"),
    ("(0008,0090)", "PN", "'Dr ' || studyID"),
    ("(0008,1010)", "SH", "stationName"),
    ("(0008,1030)", "LO", "studyDescription"),
    ("(0008,103E)", "LO", "seriesDescription"),
    ("(0008,1140)", "SQ", "''"),
    ("(0008,1140)[1].(0008,1155)", "UI", "sopInstanceUID"),
    ("(0008,1140)[2].(0008,1155)", "UI", "seriesInstanceUID"),
    ("(0009,0010)", "LO", "'ACME 1.0'"),
    ("(0009,1001)", "LO", "'private ' || instanceNumber"),
    ("(0010,0010)", "PN", "patientName"),
    ("(0010,0020)", "LO", "patientID"),
    ("(0010,0030)", "DA", "patientBirthDate"),
    ("(0010,0040)", "CS", "patientSex"),
    ("(0010,1010)", "AS", "patientAge"),
    ("(0010,21A0)", "CS", "CASE WHEN patientSex = 'M' THEN 'YES' END"),
    ("(0012,0062)", "CS", "CASE WHEN manufacturer = 'M5' THEN 'YES' WHEN manufacturer = 'M4' THEN 'yes' "
                          "WHEN manufacturer = 'M3' THEN 'NO' END"),
    ("(0012,0063)", "LO", "CASE WHEN manufacturer = 'M5' THEN 'external tool' END"),
    ("(0018,0015)", "CS", "bodyPartExamined"),
    ("(0018,1000)", "LO", "'DEV' || stationName"),
    ("(0018,1030)", "LO", "protocolName"),
    ("(0020,000D)", "UI", "studyInstanceUID"),
    ("(0020,000E)", "UI", "seriesInstanceUID"),
    ("(0020,0010)", "SH", "studyID"),
    ("(0020,0013)", "IS", "instanceNumber"),
    ("(0020,0052)", "UI", "frameOfReferenceUID"),
    ("(0020,4000)", "LT", "'seen by ' || manufacturer"),
    ("(0028,0008)", "IS", "CASE WHEN modality = 'F' THEN instanceNumber END"),
    ("(0028,0106)", "US", "CASE WHEN modality <> 'P' THEN '3' END"),
    ("(0028,0107)", "US", "CASE WHEN modality <> 'P' THEN '4095' END"),
    ("(0040,0275)", "SQ", "''"),
    ("(0040,0275)[1].(0008,0050)", "SH", "accessionNumber"),
    ("(0040,0275)[1].(0040,0007)", "LO", "protocolName"),
    ("(0054,1330)", "US", "CASE WHEN bodyPartExamined = 'B1' THEN '4' END"),
    ("(6000,3000)", "OW", "'overlay ' || sopInstanceUID || ' data words'"),
    ("(7053,1009)", "DS", "'1.23'"),
    ("(7FE0,0010)", "OB", "'pixels'"),
]

# type id, rule id, tag, sequence path ('' = root), comma-joined values; a rule without a row is an empty rule
RULES = [(1, 11), (1, 12), (2, 21), (3, 31), (4, 41), (5, 51), (6, 61)]  # type, rule
RULE_ATTRIBUTES = [
    (11, "(0008,0060)", "", "F"),
    (11, "(0018,0015)", "", "B1"),
    (12, "(0008,0060)", "", "O"),
    (12, "(0008,103E)", "", "1-URGENT"),
    (21, "(0008,0008)", "", "A,F"),
    (31, "(0018,1030)", "", "P3"),
    (51, "(0099,0099)", "", ""),  # absent attribute equals the empty string
    (61, "(0010,0040)", "", "X"),
]  # rule 41 has no attribute: it matches every series with an image
NESTED_RULES = [(1, 71), (2, 72), (3, 73)]
NESTED_RULE_ATTRIBUTES = [
    (71, "(0040,0007)", "(0040,0275)", "P4"),
    (72, "(0008,0060)", "(0008,9999)", "F"),  # unresolvable sequence: falls back to the root attribute
    (73, "(0008,0060)", "(0040,0275)", ""),  # sequence resolves, attribute absent inside it
]

# id, name, kind
TAG_FILTERS = [
    (1, "drop private", "BLACKLIST"),
    (2, "drop requests", "BLACKLIST"),
    (3, "keep core", "WHITELIST"),
    (4, "keep references", "WHITELIST"),
    (5, "keep nothing listed", "WHITELIST"),
]
TAG_FILTER_PATHS = [
    (1, 1, "(0009,1001)"),
    (2, 1, "(0009,0010)"),
    (3, 2, "(0040,0275)[*]"),
    (4, 2, "(0008,1140)[2].(0008,1155)"),
    (5, 3, "(0010,0010)"),
    (6, 3, "(0010,0020)"),
    (7, 3, "(0020,000D)"),
    (8, 3, "(0020,000E)"),
    (9, 3, "(0008,0018)"),
    (10, 4, "(0008,1140)[*].(0008,1155)"),
]
# source type, source id, filter id
SOURCE_TAG_FILTERS = [
    ("user", 0, 1), ("user", 1, 2), ("box", 2, 3), ("box", 3, 4), ("scp", 0, 1), ("scp", 0, 3),
    ("scp", 1, 2), ("scp", 1, 4), ("directory", 4, 5), ("import", 5, 2), ("import", 6, 3),
]

# id, source type, source id, destination type, destination id, keep images
FORWARDING_RULES = [
    (1, "user", 0, "box", 0, True),
    (2, "user", 0, "scu", 7, False),
    (3, "box", 1, "box", 1, False),
    (4, "scp", 2, "box", 2, True),
    (5, "directory", 3, "scu", 3, False),
    (6, "import", 4, "tape", 4, False),
    (7, "user", 5, "box", 3, False),
    (8, "box", 6, "box", 4, True),
]

SALT = "pepper"
NOW_MS = 1706659200000  # 2024-01-31T00:00:00Z
DAY_MS = 86_400_000
HOUR_MS = 3_600_000
