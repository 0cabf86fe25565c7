"""The four-level data model and the attribute dictionary (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Level:
    name: str
    rank: int
    parent: str | None
    ref: str | None  # foreign key to the parent level
    props: tuple[str, ...]
    key: tuple[str, ...]  # natural key inside the parent

    @property
    def columns(self) -> list[str]:
        return ["id", *([self.ref] if self.ref else []), *self.props]


PATIENT = Level(
    "patient", 1, None, None,
    ("patientName", "patientID", "patientBirthDate", "patientSex"),
    ("patientName", "patientID"),
)
STUDY = Level(
    "study", 2, "patient", "patient_ref",
    ("studyInstanceUID", "studyDescription", "studyDate", "studyID", "accessionNumber", "patientAge"),
    ("studyInstanceUID",),
)
SERIES = Level(
    "series", 3, "study", "study_ref",
    ("seriesInstanceUID", "seriesDescription", "seriesDate", "modality", "protocolName", "bodyPartExamined",
     "manufacturer", "stationName", "frameOfReferenceUID"),
    ("seriesInstanceUID",),
)
IMAGE = Level(
    "image", 4, "series", "series_ref",
    ("sopInstanceUID", "imageType", "instanceNumber"),
    ("sopInstanceUID",),
)

LEVELS = {lv.name: lv for lv in (PATIENT, STUDY, SERIES, IMAGE)}
LEVEL_RANK = {"PATIENT": 1, "STUDY": 2, "SERIES": 3, "IMAGE": 4}
NAME_LIMIT = 180

# Attribute dictionary as keyword, tag, value representation, multiplicity.
DICTIONARY: list[tuple[str, str, str, str]] = [
    ("TransferSyntaxUID", "(0002,0010)", "UI", "1"),
    ("SpecificCharacterSet", "(0008,0005)", "CS", "1-n"),
    ("ImageType", "(0008,0008)", "CS", "2-n"),
    ("SOPClassUID", "(0008,0016)", "UI", "1"),
    ("SOPInstanceUID", "(0008,0018)", "UI", "1"),
    ("StudyDate", "(0008,0020)", "DA", "1"),
    ("SeriesDate", "(0008,0021)", "DA", "1"),
    ("AccessionNumber", "(0008,0050)", "SH", "1"),
    ("Modality", "(0008,0060)", "CS", "1"),
    ("Manufacturer", "(0008,0070)", "LO", "1"),
    ("InstitutionName", "(0008,0080)", "LO", "1"),
    ("ReferringPhysicianName", "(0008,0090)", "PN", "1"),
    ("StationName", "(0008,1010)", "SH", "1"),
    ("StudyDescription", "(0008,1030)", "LO", "1"),
    ("SeriesDescription", "(0008,103E)", "LO", "1"),
    ("ReferencedImageSequence", "(0008,1140)", "SQ", "1"),
    ("ReferencedSOPInstanceUID", "(0008,1155)", "UI", "1"),
    ("PatientName", "(0010,0010)", "PN", "1"),
    ("PatientID", "(0010,0020)", "LO", "1"),
    ("PatientBirthDate", "(0010,0030)", "DA", "1"),
    ("PatientSex", "(0010,0040)", "CS", "1"),
    ("PatientAge", "(0010,1010)", "AS", "1"),
    ("SmokingStatus", "(0010,21A0)", "CS", "1"),
    ("PatientIdentityRemoved", "(0012,0062)", "CS", "1"),
    ("DeidentificationMethod", "(0012,0063)", "LO", "1-n"),
    ("BodyPartExamined", "(0018,0015)", "CS", "1"),
    ("DeviceSerialNumber", "(0018,1000)", "LO", "1"),
    ("ProtocolName", "(0018,1030)", "LO", "1"),
    ("StudyInstanceUID", "(0020,000D)", "UI", "1"),
    ("SeriesInstanceUID", "(0020,000E)", "UI", "1"),
    ("StudyID", "(0020,0010)", "SH", "1"),
    ("InstanceNumber", "(0020,0013)", "IS", "1"),
    ("FrameOfReferenceUID", "(0020,0052)", "UI", "1"),
    ("ImageComments", "(0020,4000)", "LT", "1"),
    ("NumberOfFrames", "(0028,0008)", "IS", "1"),
    ("SmallestImagePixelValue", "(0028,0106)", "US", "1"),
    ("LargestImagePixelValue", "(0028,0107)", "US", "1"),
    ("ScheduledProcedureStepDescription", "(0040,0007)", "LO", "1"),
    ("RequestAttributesSequence", "(0040,0275)", "SQ", "1"),
    ("ImageIndex", "(0054,1330)", "US", "1"),
    ("PixelData", "(7FE0,0010)", "OW", "1"),
]


def tag_number(tag: str) -> int:
    """``(gggg,eeee)`` as an unsigned 32-bit number."""
    return int(tag.strip("()").replace(",", ""), 16)


def path_numbers(path: str) -> list[int]:
    """Tag numbers along ``(gggg,eeee)[item].(gggg,eeee)``."""
    return [tag_number(step.split("[")[0]) for step in path.split(".")]


TAG = {keyword: tag_number(tag) for keyword, tag, _, _ in DICTIONARY}
TAG_TEXT = {keyword: tag for keyword, tag, _, _ in DICTIONARY}

# the promoted properties: column name -> dictionary keyword
PROPERTY_KEYWORD = {p: p[0].upper() + p[1:] for lv in LEVELS.values() for p in lv.props}
PROPERTY_KEYWORD["sopInstanceUID"] = "SOPInstanceUID"

# The five identity attributes and their level.
IDENTITY = [
    ("PatientName", "PATIENT"),
    ("PatientID", "PATIENT"),
    ("StudyInstanceUID", "STUDY"),
    ("SeriesInstanceUID", "SERIES"),
    ("SOPInstanceUID", "IMAGE"),
]

# Attributes whose real/anonymous pairs are kept, beyond the identity.
MANDATORY_VALUES = [*IDENTITY, ("PatientIdentityRemoved", "IMAGE"), ("DeidentificationMethod", "IMAGE")]
OPTIONAL_VALUES = [
    ("AccessionNumber", "STUDY"),
    ("StudyDescription", "STUDY"),
    ("SeriesDescription", "SERIES"),
    ("PatientBirthDate", "PATIENT"),
    ("ProtocolName", "SERIES"),
    ("StudyID", "STUDY"),
    ("FrameOfReferenceUID", "STUDY"),
]

# Storage classes and encodings accepted on import.
ACCEPTED_SYNTAXES = [
    "1.2.840.10008.1.2",
    "1.2.840.10008.1.2.1",
    "1.2.840.10008.1.2.2",
    "1.2.840.10008.1.2.1.99",
    "1.2.840.10008.1.2.4.50",
]
ACCEPTED_IMAGE_CLASSES = [
    "1.2.840.10008.5.1.4.1.1.1",
    "1.2.840.10008.5.1.4.1.1.1.1",
    "1.2.840.10008.5.1.4.1.1.501.2.2",
    "1.2.840.10008.5.1.4.1.1.1.2",
    "1.2.840.10008.5.1.4.1.1.1.2.1",
    "1.2.840.10008.5.1.4.1.1.1.3",
    "1.2.840.10008.5.1.4.1.1.1.3.1",
    "1.2.840.10008.5.1.4.1.1.2",
    "1.2.840.10008.5.1.4.1.1.2.1",
    "1.2.840.10008.5.1.4.1.1.3",
    "1.2.840.10008.5.1.4.1.1.3.1",
    "1.2.840.10008.5.1.4.1.1.4",
    "1.2.840.10008.5.1.4.1.1.4.1",
    "1.2.840.10008.5.1.4.1.1.4.2",
    "1.2.840.10008.5.1.4.1.1.6",
    "1.2.840.10008.5.1.4.1.1.6.1",
    "1.2.840.10008.5.1.4.1.1.12.1",
    "1.2.840.10008.5.1.4.1.1.12.1.1",
    "1.2.840.10008.5.1.4.1.1.12.2",
    "1.2.840.10008.5.1.4.1.1.12.2.1",
    "1.2.840.10008.5.1.4.1.1.13.1.1",
    "1.2.840.10008.5.1.4.1.1.13.1.2",
    "1.2.840.10008.5.1.4.1.1.13.1.3",
    "1.2.840.10008.5.1.4.1.1.14.1",
    "1.2.840.10008.5.1.4.1.1.14.2",
    "1.2.840.10008.5.1.4.1.1.20",
    "1.2.840.10008.5.1.4.1.1.77.1.1",
    "1.2.840.10008.5.1.4.1.1.77.1.2",
    "1.2.840.10008.5.1.4.1.1.77.1.3",
    "1.2.840.10008.5.1.4.1.1.77.1.5.1",
    "1.2.840.10008.5.1.4.1.1.77.1.5.2",
    "1.2.840.10008.5.1.4.1.1.77.1.5.4",
    "1.2.840.10008.5.1.4.1.1.77.1.6",
    "1.2.840.10008.5.1.4.1.1.128",
    "1.2.840.10008.5.1.4.1.1.130",
    "1.2.840.10008.5.1.4.1.1.481.1",
    "1.2.840.10008.5.1.4.1.1.66.4",
]
ACCEPTED_EXTENDED_CLASSES = [
    "1.2.840.10008.5.1.4.1.1.7",
    "1.2.840.10008.5.1.4.1.1.7.1",
    "1.2.840.10008.5.1.4.1.1.7.2",
    "1.2.840.10008.5.1.4.1.1.7.3",
    "1.2.840.10008.5.1.4.1.1.7.4",
]

SOURCE_TYPES = ("scp", "directory", "box", "user", "import", "unknown")
