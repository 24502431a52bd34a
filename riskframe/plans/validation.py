"""Validate-then-merge job (DQ13): schema check -> first run stores; later runs
measure drift, stop on drift, run the test suite and insert the rows with new keys.

The parts (train and test) live in one versioned store: a run reads one pinned version, writes
the rows it adds and makes them visible for all parts in one step.  A run that dies before that step
changes nothing, a lost folder makes the next run continue from the last whole version,
and a store that lost all its versions is an error rather than a first run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..config import DriftConfig
from ..operators.drift import dataset_drift, drift_table
from ..operators.merge import rows_to_insert
from ..operators.quality import all_passed, schema_conformance, test_suite
from ..sources.versions import VersionedStore


class DataDriftError(RuntimeError):
    """Raised when the current table drifted from the stored reference."""


@dataclass
class ValidationResult:
    schema_ok: bool
    first_run: bool
    drift: bool
    inserted: dict          # rows inserted per part; None on the first run
    suite_passed: bool | None


def validate_and_merge(parts: Mapping[str, DataFrame], store: str, declared: Mapping[str, str], key: str,
                       numeric: Sequence[str], categorical: Sequence[str],
                       cfg: DriftConfig = DriftConfig(), drift_part: str = "train") -> ValidationResult:
    """Run DQ1 -> SRC3 -> DR5 -> DQ9 -> JOIN1 -> SET1 -> SNK2; the schema is checked on every
    part (train and test), drift and the test suite on ``drift_part``.  Drift stops the job;
    the suite's outcome is reported.  A part that the store does not hold yet is stored whole."""
    spark = next(iter(parts.values())).sparkSession
    schema_ok = all(schema_conformance(df, declared).where("missing OR bad_rows > 0").isEmpty() for df in parts.values())
    versions = VersionedStore(spark, store)
    base = versions.snapshot()
    if base is None:
        if schema_ok:
            versions.commit(parts)
        return ValidationResult(schema_ok, True, False, {n: None for n in parts}, None)
    if drift_part not in base.parts:
        raise ValueError(f"{store} has no part {drift_part} to compare with")
    refs = {name: base.read(spark, name) for name in parts if name in base.parts}
    verdict = dataset_drift(drift_table(refs[drift_part], parts[drift_part], numeric, categorical, cfg), cfg).first()
    if verdict["dataset_drift"]:
        raise DataDriftError("Data drift found")
    suite = test_suite(refs[drift_part], parts[drift_part], [*numeric, *categorical], drifted=verdict["n_drifted"])
    suite_passed = all_passed(suite).first()["all_passed"]
    inserted = {}
    if schema_ok:
        new = {name: rows_to_insert(df, refs[name], key) if name in refs else df for name, df in parts.items()}
        done = versions.commit({n: df for n, df in new.items() if n not in refs},
                               {n: df for n, df in new.items() if n in refs}, base)
        inserted = {n: done.rows(n) - (base.rows(n) if n in refs else 0) for n in parts}
    return ValidationResult(schema_ok, False, False, inserted, suite_passed)
