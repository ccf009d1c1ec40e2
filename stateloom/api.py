"""One object from specification to root, tables, layouts and manifest."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from stateloom.plans import state, templates
from stateloom.sources import manifest, spec


@dataclass(frozen=True)
class StateConfig:
    """The request: seed, byte budget (0: none), nibbles by which tries are dealt."""

    seed: int = 42
    target_size: int = 0
    prefix: int = 1


class StateFrame:
    """Lazy tables of one specification."""

    def __init__(self, spark: SparkSession, text: str, config: StateConfig | None = None):
        self.spark, self.text, self.config = spark, text, config or StateConfig()
        entities = spec.parse(text)
        self.warnings = spec.validate(entities, set(templates.REGISTRY))
        self.entities = spec.truncate(spec.resolve(entities, self.config.seed), self.config.target_size)
        self.tables: dict[str, DataFrame] = templates.expand(spark, self.entities, self.config.seed)

    def root(self) -> bytes:
        row = state.state_root(self.tables["accounts"], self.tables["storage"], self.config.prefix).first()
        return bytes(row.root) if row else state.EMPTY_ROOT

    def write(self, folder: str, layout: str = "snapshot") -> None:
        rooted = state.with_roots(self.tables["accounts"], self.tables["storage"], self.config.prefix)
        codes = rooted.filter("code is not null").select("code_hash", "code").dropDuplicates(["code_hash"])
        state.write_layout(state.layouts(rooted, self.tables["storage"], codes)[layout], folder)

    def record(self, folder: str) -> str:
        return manifest.write_manifest(folder, asdict(self.config), self.root(), self.text)


def reproduce(spark: SparkSession, path: str) -> bool:
    """Whether building the recorded request again gives the recorded root."""
    record, text = manifest.read_manifest(path)
    if text is None:
        raise ValueError("manifest without a specification")
    return "0x" + StateFrame(spark, text, StateConfig(**record["request"])).root().hex() == record["state_root"]
