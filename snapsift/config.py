"""Study configuration and thresholds."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

# They decide which tables, columns and records count.
MIN_TABLE_COLUMNS = 0
MAX_TABLE_COLUMNS = 10_000
DEFAULT_ID_COLS = ("centre", "id")
MAX_KEY_COLS = 3
KEY_NAME_PATTERNS = (r".+rn\d?$", r".+rptn\d?$", r"^dfseq$", r"visit$", r"report")
SYSTEM_PREFIX = "df"
KEEP_SYSTEM_COLS = ("dfseq",)
TYPED_COLS = {"centre": "int", "id": "int", "dfseq": "int"}
RECORD_CHANGE_FRACTION = 0.2
COLUMN_CHANGE_FRACTION = 0.25
PLATE_MIN_ROWS = 10
PLATE_MIN_COLUMNS = 5
MAX_MISSING_FRACTION = 0.999
IGNORED_VARIABLES = ("PSIGN", "PSDATE", "pinit", "init", "help")
IGNORED_CENTRES = (999,)
MIN_PARTICIPANTS_PER_CENTRE = 2
#: Failure kind -> what it means.
FAILURES = {
    "ExcludedTable": "the study configuration leaves this table out",
    "DataFrameLoadingException": "the table could not be read",
    "DataFrameTooLarge": "the plan for this table was too large to run",
    "PreliminarySnapshotTooWide": "more columns than allowed in the preliminary table",
    "GoldStandardSnapshotTooWide": "more columns than allowed in the gold table",
    "PreliminarySnapshotTooNarrow": "fewer columns than allowed in the preliminary table",
    "GoldStandardSnapshotTooNarrow": "fewer columns than allowed in the gold table",
    "EmptyTableSnapshot": "the preliminary table has no rows",
    "GoldStandardTableNotFound": "the gold snapshot has no table of this name",
    "NoMeaningfulData": "no changed record, or no column besides the key",
    "ParticipantIdentifierNotAvailable": "an identifier column is missing",
    "SufficientIdentifiersNotAvailable": "no allowed set of columns is a key",
    "DuplicatesUncountable": "duplicates cannot be counted for these columns",
    "SnapshotSchemaChange": "column names or types differ between the snapshots",
    "DiffIdentifiersInsufficient": "the key does not identify the changed cells",
    "MetadataUnavailable": "the study has no table list",
}
# End of fixed values.


class TableFailure(Exception):
    """A table that cannot be compared; ``kind`` is one of :data:`FAILURES`."""

    def __init__(self, kind: str, message: str | None = None):
        super().__init__(message or FAILURES[kind])
        self.kind = kind
        self.message = message or FAILURES[kind]


@dataclass(frozen=True)
class StudyConfig:
    """One study: where its snapshots are and how its tables are treated."""

    name: str
    root: str
    gold: str
    preliminary: tuple[str, ...]
    root_subdir: str = ""
    metadata_unavailable: bool = False
    metadata_filename: str | None = None
    metadata_column: str = "SAS libraries"
    metadata_header: int = 1
    exclude_tables: tuple[str, ...] = ()
    additional_identifiers: dict[str, list[str]] = field(default_factory=dict)
    id_cols: tuple[str, ...] = DEFAULT_ID_COLS
    max_key_cols: int = MAX_KEY_COLS
    label_exclude_tables: tuple[str, ...] = ()
    label_exclude_fields: tuple[str, ...] = ()
    column_threshold: float = COLUMN_CHANGE_FRACTION
    record_threshold: float = RECORD_CHANGE_FRACTION
    #: Whether columns left out of the labels leave the features too.
    drop_excluded: bool = True

    @classmethod
    def from_toml(cls, path: str) -> "StudyConfig":
        """Read the sections name, root, snapshots, metadata, tables, overrides, label_derivation."""
        with open(path, "rb") as handle:
            raw = tomllib.load(handle)
        snapshots = raw["snapshots"]
        metadata, tables = raw.get("metadata", {}), raw.get("tables", {})
        overrides, labelling = raw.get("overrides", {}), raw.get("label_derivation", {})
        return cls(
            name=raw["name"],
            root=raw["root"],
            gold=snapshots["gold_standard"],
            preliminary=tuple(snapshots["preliminary"]),
            root_subdir=snapshots.get("root_subdir", ""),
            metadata_unavailable=bool(metadata.get("unavailable", False)),
            metadata_filename=metadata.get("filename"),
            metadata_column=metadata.get("column_name", "SAS libraries"),
            metadata_header=metadata.get("header", 1),
            exclude_tables=tuple(tables.get("exclude", ())),
            additional_identifiers=dict(tables.get("additional_identifiers", {})),
            id_cols=tuple(overrides.get("default_id_cols", DEFAULT_ID_COLS)),
            max_key_cols=overrides.get("max_num_id_cols", MAX_KEY_COLS),
            label_exclude_tables=tuple(labelling.get("exclude_tables", ())),
            label_exclude_fields=tuple(labelling.get("exclude_fields", ())),
            column_threshold=labelling.get("column_threshold", COLUMN_CHANGE_FRACTION),
            record_threshold=labelling.get("record_threshold", RECORD_CHANGE_FRACTION),
            drop_excluded=bool(labelling.get("drop_excluded", True)),
        )

    def snapshot_root(self, snapshot: str) -> str:
        parts = [self.root, self.root_subdir, snapshot]
        return "/".join(p.rstrip("/") for p in parts if p)
