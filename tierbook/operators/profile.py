"""Confidentiality options, attribute operations, and their resolution into one column expression.

The option table is a program constant of bounded size, so ranks are settled while the plan is built and the winner per
attribute becomes a literal set test plus a short mask chain: no join, no broadcast, code-generated.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierbook.schema import TAG
from tierbook.sources.dims import constant_table

FULL_MASK = 0xFFFFFFFF

# Name, description, title, supported, rank.
OPTIONS = [
    ("BASIC_PROFILE", "Basic Profile", "Basic Profile", True, 10),
    ("CLEAN_PIXEL_DATA", "Clean Pixel Data", "Clean Pixel Data", False, 20),
    ("CLEAN_RECOGNIZABLE_VISUAL_FEATURES", "Clean Recognizable Visual Features", "Clean Visual Features", False, 30),
    ("CLEAN_GRAPHICS", "Clean Graphics", "Clean Graphics", False, 40),
    ("CLEAN_STRUCTURED_CONTENT", "Clean Structured Content", "Clean Structured Content", False, 50),
    ("CLEAN_DESCRIPTORS", "Clean Descriptors", "Clean Descriptors", False, 60),
    ("RETAIN_LONGITUDINAL_TEMPORAL_INFORMATION", "Retain Longitudinal Temporal Information", "Retain Temporal Info", True,
     70),
    ("RETAIN_LONGITUDINAL_TEMPORAL_INFORMATION_MODIFIED_DATES",
     "Retain Longitudinal Temporal Information with Modified Dates", "Retain Modified Temporal Info", False, 80),
    ("RETAIN_PATIENT_CHARACTERISTICS", "Retain Patient Characteristics", "Retain Patient Characteristics", True, 90),
    ("RETAIN_DEVICE_IDENTITY", "Retain Device Identity", "Retain Device Identity", True, 100),
    ("RETAIN_INSTITUTION_IDENTITY", "Retain Institution Identity", "Retain Institution Identity", True, 110),
    ("RETAIN_UIDS", "Retain UIDs", "Retain UIDs", True, 120),
    ("RETAIN_SAFE_PRIVATE", "Retain Safe Private Attributes", "Retain Safe Private Attributes", True, 130),
]

# Operation codes of the public confidentiality profile and what this package does for them.
OPERATIONS = [
    ("D", "dummy value", "zero"),
    ("Z", "zero length", "zero"),
    ("X", "remove", "remove"),
    ("K", "keep", "keep"),
    ("C", "clean", "zero"),
    ("U", "replace UID", "uid"),
    ("Z/D", "zero or dummy", "zero"),
    ("X/Z", "remove or zero", "remove"),
    ("X/D", "remove or dummy", "remove"),
    ("X/Z/D", "remove, zero or dummy", "remove"),
    ("X/Z/U*", "remove, zero or replace UIDs", "remove"),
    ("", "unknown", "keep"),
]
EFFECT = {code: effect for code, _, effect in OPERATIONS}

# Public confidentiality profile (PS3.15 table E.1-1), attribute pattern and operation, as far as it concerns
# common headers; read_operations takes the complete table.
# An x stands for any digit; "odd" stands for any odd group.
ATTRIBUTE_OPS: dict[str, list[tuple[str, str]]] = {
    "BASIC_PROFILE": [
        ("0000,1000", "X"),
        ("0000,1001", "U"),
        ("0002,0003", "U"),
        ("0008,0014", "U"),
        ("0008,0018", "U"),
        ("0008,0020", "Z"),
        ("0008,0021", "X/D"),
        ("0008,0022", "X/Z"),
        ("0008,0023", "Z/D"),
        ("0008,0024", "X"),
        ("0008,0025", "X"),
        ("0008,002A", "X/D"),
        ("0008,0030", "Z"),
        ("0008,0031", "X/D"),
        ("0008,0032", "X/Z"),
        ("0008,0033", "Z/D"),
        ("0008,0034", "X"),
        ("0008,0035", "X"),
        ("0008,0050", "Z"),
        ("0008,0058", "U"),
        ("0008,0080", "X/Z/D"),
        ("0008,0081", "X"),
        ("0008,0082", "X/Z/D"),
        ("0008,0090", "Z"),
        ("0008,0092", "X"),
        ("0008,0094", "X"),
        ("0008,0096", "X"),
        ("0008,009C", "Z"),
        ("0008,009D", "X"),
        ("0008,0201", "X"),
        ("0008,1010", "X/Z/D"),
        ("0008,1030", "X"),
        ("0008,103E", "X"),
        ("0008,1040", "X"),
        ("0008,1048", "X"),
        ("0008,1049", "X"),
        ("0008,1050", "X"),
        ("0008,1052", "X"),
        ("0008,1060", "X"),
        ("0008,1062", "X"),
        ("0008,1070", "X/Z/D"),
        ("0008,1072", "X/D"),
        ("0008,1080", "X"),
        ("0008,1084", "X"),
        ("0008,1110", "X/Z"),
        ("0008,1111", "X/Z/D"),
        ("0008,1120", "X"),
        ("0008,1140", "X/Z/U*"),
        ("0008,1155", "U"),
        ("0008,1195", "U"),
        ("0008,2111", "X"),
        ("0008,2112", "X/Z/U*"),
        ("0008,3010", "U"),
        ("0008,4000", "X"),
        ("0010,0010", "Z"),
        ("0010,0020", "Z"),
        ("0010,0021", "X"),
        ("0010,0030", "Z"),
        ("0010,0032", "X"),
        ("0010,0040", "Z"),
        ("0010,0050", "X"),
        ("0010,0101", "X"),
        ("0010,0102", "X"),
        ("0010,1000", "X"),
        ("0010,1001", "X"),
        ("0010,1002", "X"),
        ("0010,1005", "X"),
        ("0010,1010", "X"),
        ("0010,1020", "X"),
        ("0010,1030", "X"),
        ("0010,1040", "X"),
        ("0010,1050", "X"),
        ("0010,1060", "X"),
        ("0010,1080", "X"),
        ("0010,1081", "X"),
        ("0010,1090", "X"),
        ("0010,2000", "X"),
        ("0010,2110", "X"),
        ("0010,2150", "X"),
        ("0010,2152", "X"),
        ("0010,2154", "X"),
        ("0010,2155", "X"),
        ("0010,2160", "X"),
        ("0010,2180", "X"),
        ("0010,21A0", "X"),
        ("0010,21B0", "X"),
        ("0010,21C0", "X"),
        ("0010,21D0", "X"),
        ("0010,21F0", "X"),
        ("0010,2203", "X/Z"),
        ("0010,2297", "X"),
        ("0010,2299", "X"),
        ("0010,4000", "X"),
        ("0018,0010", "Z/D"),
        ("0018,1000", "X/Z/D"),
        ("0018,1002", "U"),
        ("0018,1004", "X"),
        ("0018,1005", "X"),
        ("0018,1007", "X"),
        ("0018,1008", "X"),
        ("0018,1030", "X/D"),
        ("0018,1400", "X/D"),
        ("0018,2042", "U"),
        ("0018,4000", "X"),
        ("0018,700A", "X"),
        ("0018,A003", "X"),
        ("0020,000D", "U"),
        ("0020,000E", "U"),
        ("0020,0010", "Z"),
        ("0020,0052", "U"),
        ("0020,0200", "U"),
        ("0020,3401", "X"),
        ("0020,3404", "X"),
        ("0020,3406", "X"),
        ("0020,4000", "X"),
        ("0020,9158", "X"),
        ("0020,9161", "U"),
        ("0020,9164", "U"),
        ("0028,1199", "U"),
        ("0028,1214", "U"),
        ("0028,4000", "X"),
        ("0032,0012", "X"),
        ("0032,1020", "X"),
        ("0032,1021", "X"),
        ("0032,1030", "X"),
        ("0032,1032", "X"),
        ("0032,1033", "X"),
        ("0032,1060", "X/Z"),
        ("0032,1070", "X"),
        ("0032,4000", "X"),
        ("0038,0010", "X"),
        ("0038,0011", "X"),
        ("0038,001E", "X"),
        ("0038,0020", "X"),
        ("0038,0021", "X"),
        ("0038,0040", "X"),
        ("0038,0050", "X"),
        ("0038,0060", "X"),
        ("0038,0061", "X"),
        ("0038,0062", "X"),
        ("0038,0300", "X"),
        ("0038,0400", "X"),
        ("0038,0500", "X"),
        ("0038,4000", "X"),
        ("0040,0005", "X"),
        ("0040,0006", "X"),
        ("0040,0007", "X"),
        ("0040,000B", "X"),
        ("0040,0012", "X"),
        ("0040,0244", "X"),
        ("0040,0245", "X"),
        ("0040,0248", "X"),
        ("0040,0253", "X"),
        ("0040,0254", "X"),
        ("0040,0275", "X"),
        ("0040,0280", "X"),
        ("0040,0555", "X"),
        ("0040,1001", "X"),
        ("0040,1004", "X"),
        ("0040,1005", "X"),
        ("0040,1010", "X"),
        ("0040,1011", "X"),
        ("0040,1101", "D"),
        ("0040,1102", "X"),
        ("0040,1103", "X"),
        ("0040,1400", "X"),
        ("0040,2001", "X"),
        ("0040,2008", "X"),
        ("0040,2009", "X"),
        ("0040,2010", "X"),
        ("0040,2016", "Z"),
        ("0040,2017", "Z"),
        ("0040,2400", "X"),
        ("0040,3001", "X"),
        ("0040,4023", "U"),
        ("0040,4025", "X"),
        ("0040,4027", "X"),
        ("0040,4034", "X"),
        ("0040,4035", "X"),
        ("0040,4036", "X"),
        ("0040,4037", "X"),
        ("0040,A073", "D"),
        ("0040,A075", "D"),
        ("0040,A123", "D"),
        ("0040,A124", "U"),
        ("0070,0084", "Z"),
        ("0070,0086", "X"),
        ("0088,0140", "U"),
        ("0088,0200", "X"),
        ("50xx,xxxx", "X"),
        ("60xx,3000", "X"),
        ("60xx,4000", "X"),
        ("odd", "X"),
    ],
    "RETAIN_UIDS": [
        ("0000,1001", "K"),
        ("0002,0003", "K"),
        ("0008,0014", "K"),
        ("0008,0018", "K"),
        ("0008,1140", "K"),
        ("0008,1155", "K"),
        ("0008,2112", "K"),
        ("0008,3010", "K"),
        ("0018,1002", "K"),
        ("0018,2042", "K"),
        ("0020,000D", "K"),
        ("0020,000E", "K"),
        ("0020,0052", "K"),
        ("0020,0200", "K"),
    ],
    "RETAIN_DEVICE_IDENTITY": [
        ("0008,1010", "K"),
        ("0018,1000", "K"),
        ("0018,1002", "K"),
        ("0018,700A", "K"),
    ],
    "RETAIN_INSTITUTION_IDENTITY": [
        ("0008,0080", "K"),
        ("0008,0081", "K"),
        ("0008,1040", "K"),
    ],
    "RETAIN_PATIENT_CHARACTERISTICS": [
        ("0010,0040", "K"),
        ("0010,1010", "K"),
        ("0010,1020", "K"),
        ("0010,1030", "K"),
        ("0010,2160", "K"),
        ("0010,21A0", "K"),
        ("0010,2110", "C"),
    ],
    "RETAIN_LONGITUDINAL_TEMPORAL_INFORMATION": [
        ("0008,0020", "K"),
        ("0008,0021", "K"),
        ("0008,0022", "K"),
        ("0008,0023", "K"),
        ("0008,002A", "K"),
        ("0008,0030", "K"),
        ("0008,0031", "K"),
        ("0008,0032", "K"),
        ("0008,0033", "K"),
    ],
    "RETAIN_SAFE_PRIVATE": [
        ("7053,xx00", "K"),
        ("7053,xx09", "K"),
        ("00E1,xx21", "K"),
        ("01E1,xx26", "K"),
        ("01F1,xx01", "K"),
        ("01F1,xx07", "K"),
        ("01F1,xx26", "K"),
        ("01F1,xx27", "K"),
        ("0019,xx23", "K"),
        ("0019,xx24", "K"),
        ("0019,xx27", "K"),
        ("0043,xx27", "K"),
        ("0043,xx6F", "K"),
        ("0045,xx01", "K"),
        ("0045,xx02", "K"),
        ("0903,xx10", "K"),
        ("0903,xx11", "K"),
        ("0903,xx12", "K"),
        ("2001,xx03", "K"),
        ("2001,xx04", "K"),
        ("2005,xx0D", "K"),
        ("2005,xx0E", "K"),
        ("0019,xx0C", "K"),
        ("0019,xx0D", "K"),
        ("0019,xx0E", "K"),
        ("0051,xx0F", "K"),
        ("0019,xx1E", "K"),
    ],
}


def pattern(text: str) -> tuple[int, int]:
    """(tag, mask) of an attribute pattern."""
    if text == "odd":
        return 0x00010000, 0x00010000
    digits = text.replace(",", "")
    tag = int(digits.replace("x", "0"), 16)
    mask = int("".join("0" if d == "x" else "F" for d in digits), 16)
    return tag, mask


RANK = {name: rank for name, _, _, _, rank in OPTIONS}
DESCRIPTION = {name: text for name, text, _, _, _ in OPTIONS}
SUPPORTED = {name for name, _, _, ok, _ in OPTIONS if ok}


BUILT_IN = tuple((option, text, code) for option, ops in ATTRIBUTE_OPS.items() for text, code in ops)


def read_operations(path: str) -> tuple[tuple[str, str, str], ...]:
    """(option, attribute pattern, operation) from a CSV file with these columns: the complete table of the standard, in the
    edition that applies.  ``Profile(options, read_operations(path))`` uses it instead of the built-in part."""
    with open(path, newline="", encoding="utf-8") as rows:
        found = tuple((r["option"], r["attribute"], r["operation"]) for r in csv.DictReader(rows))
    unknown = {o for o, _, _ in found} - set(RANK) | {c for _, _, c in found} - set(EFFECT)
    if unknown:
        raise ValueError(f"no such option or operation {sorted(unknown)}")
    return found


def profile_rows(operations: tuple[tuple[str, str, str], ...] = BUILT_IN) -> list[tuple[str, int, int, int, str]]:
    """(option, rank, tag, mask, op)"""
    return [(o, RANK[o], *pattern(p), code) for o, p, code in operations]


@dataclass(frozen=True)
class Profile:
    """Options over a table of operations.

    ``unlisted`` is what happens to an attribute that no chosen option speaks about and that is not in ``safe``: keep (right only
    where ``operations`` is the complete table of an edition), zero or remove.  ``safe`` are tags known to identify nobody; the
    attributes of the data model by default.
    """

    options: tuple[str, ...]
    operations: tuple[tuple[str, str, str], ...] = BUILT_IN
    unlisted: str = "keep"
    safe: frozenset[int] = frozenset(TAG.values())

    def __post_init__(self):
        if self.unlisted not in ("keep", "zero", "remove"):
            raise ValueError(f"unlisted attributes cannot be treated by {self.unlisted}")
        unknown = [o for o in self.options if o not in RANK]
        unsupported = [o for o in self.options if o in RANK and o not in SUPPORTED]
        if unknown or unsupported:
            raise ValueError(f"no such option {unknown}, not supported {unsupported}")

    def completed(self) -> Profile:
        return self if "BASIC_PROFILE" in self.options else replace(self, options=("BASIC_PROFILE", *self.options))

    @property
    def method(self) -> str:
        return " - ".join(DESCRIPTION[o] for o in self.options)

    @cached_property
    def rows(self) -> list[tuple[str, int, int, int, str]]:
        return sorted((r for r in profile_rows(self.operations) if r[0] in self.options), key=lambda r: -r[1])

    @cached_property
    def _exact(self) -> dict[int, str]:
        """Winning operation of every attribute named in full: higher rank wins, a mask wins a tie."""
        winners: dict[int, str] = {}
        for _, rank, tag, mask, code in self.rows:
            if mask == FULL_MASK and tag not in winners:
                masked = next((r for r in self.rows if r[3] != FULL_MASK and tag & r[3] == r[2]), None)
                winners[tag] = masked[4] if masked and masked[1] >= rank else code
        return winners

    def op_of(self, tag: int) -> str | None:
        if tag in self._exact:
            return self._exact[tag]
        return next((r[4] for r in self.rows if r[3] != FULL_MASK and tag & r[3] == r[2]), None)

    def effect_of(self, tag: int) -> str:
        """remove / zero / uid / keep of a known attribute."""
        op = self.op_of(tag)
        if op is not None:
            return EFFECT[op]
        return "keep" if tag in self.safe else self.unlisted

    def removes(self, path_tags: list[int]) -> bool:
        """Whether an operation on a known attribute, or on any sequence around it, removes it."""
        return any(self.effect_of(t) == "remove" for t in path_tags)

    def names(self, path_tags: list[int]) -> bool:
        """Whether an option speaks about a known attribute and all sequences around it, or they are known to be safe."""
        return all(self.op_of(t) is not None or t in self.safe for t in path_tags)

    def case_sql(self, tag: str, value_of=lambda code: code) -> str:
        """``value_of(code)`` of the winning operation as SQL text over a tag column or lambda variable, null without one.

        Text keeps plan building cheap: one call instead of one per attribute.
        """
        by_value: dict[str, list[int]] = {}
        for number, code in self._exact.items():
            by_value.setdefault(value_of(code), []).append(number)
        whens = [f"WHEN {tag} IN ({', '.join(f'{n}L' for n in numbers)}) THEN '{value}'" for value, numbers in by_value.items()]
        whens += [f"WHEN ({tag} & {mask}L) = {masked}L THEN '{value_of(code)}'"
                  for _, _, masked, mask, code in self.rows if mask != FULL_MASK]
        return f"CASE {' '.join(whens)} END" if whens else "CAST(NULL AS STRING)"

    def unlisted_sql(self, tag: str = "tag") -> str:
        """Whether no option speaks about a tag and it is not known to be safe."""
        safe = ", ".join(f"{n}L" for n in sorted(self.safe))
        return f"({self.case_sql(tag, lambda code: 'listed')} IS NULL" + (f" AND {tag} NOT IN ({safe}))" if safe else ")")

    def op_column(self, tag: str = "tag") -> Column:
        return F.expr(self.case_sql(tag))

    def effect_sql(self, tag: str = "tag") -> str:
        """remove / zero / uid / keep"""
        rest = "'keep'" if self.unlisted == "keep" else f"if({self.unlisted_sql(tag)}, '{self.unlisted}', 'keep')"
        return f"coalesce({self.case_sql(tag, lambda code: EFFECT[code])}, {rest})"

    def removed_sql(self, effect: str | None = None) -> str:
        """An operation on the attribute or on any sequence around it removes the row; ``effect`` is a ready column."""
        return (f"CASE WHEN size(path_tags) = 1 THEN {effect or self.effect_sql()} = 'remove' "
                f"ELSE exists(path_tags, t -> {self.effect_sql('t')} = 'remove') END")


def option_dim(spark: SparkSession) -> DataFrame:
    return constant_table(spark, OPTIONS, {"name": "string", "description": "string", "title": "string",
                                           "supported": "boolean", "rank": "bigint"})


def selectable_options(spark: SparkSession) -> DataFrame:
    return option_dim(spark).filter("supported AND name <> 'BASIC_PROFILE'")


def profile_dim(spark: SparkSession) -> DataFrame:
    return constant_table(spark, profile_rows(), {"option": "string", "rank": "bigint", "tag": "bigint", "mask": "bigint",
                                                  "op": "string"})
