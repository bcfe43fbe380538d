"""Sample designs and normalisation factors: small files that are aligned with a matrix's columns on the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _pairs(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Sample and value of each line; bounded by the number of samples."""
    out = []
    for row in spark.read.text(path).collect():
        parts = row[0].split()
        if not parts:
            continue
        if len(parts) < 2:
            raise ValueError(f"design line without a value: {row[0]!r}")
        out.append((parts[0], parts[1]))
    return out


def up_down(samples: list[str], pairs: list[tuple[str, str]], neutral_unlisted: bool = False) -> list[str | None]:
    """UP or DOWN for each column; the first of repeated lines counts. Unlisted samples are DOWN, or None if neutral."""
    known: dict[str, str] = {}
    for sample, status in pairs:
        if status not in ("UP", "DOWN"):
            raise ValueError(f"unknown status {status!r}")
        known.setdefault(sample, status)
    return [known.get(s, None if neutral_unlisted else "DOWN") for s in samples]


def _once(samples: list[str]) -> None:
    if twice := sorted({s for s in samples if samples.count(s) > 1}):
        raise ValueError(f"sample names that occur more than once: {', '.join(twice)}")


def labels(samples: list[str], pairs: list[tuple[str, str]]) -> list[int]:
    """Class numbers in order of first appearance among the columns; the last of repeated lines counts. Sample names must differ."""
    _once(samples)
    known = dict(pairs)
    if missing := [s for s in samples if s not in known]:
        raise ValueError(f"samples without a label: {', '.join(missing)}")
    number: dict[str, int] = {}
    return [number.setdefault(known[s], len(number)) for s in samples]


def values(samples: list[str], pairs: list[tuple[str, str]]) -> list[float]:
    _once(samples)
    known = dict(pairs)
    if missing := [s for s in samples if s not in known]:
        raise ValueError(f"samples without a value: {', '.join(missing)}")
    return [float(known[s]) for s in samples]


def up_down_design(spark: SparkSession, path: str, samples: list[str], neutral_unlisted: bool = False) -> list[str | None]:
    return up_down(samples, _pairs(spark, path), neutral_unlisted)


def label_design(spark: SparkSession, path: str, samples: list[str]) -> list[int]:
    return labels(samples, _pairs(spark, path))


def continuous_design(spark: SparkSession, path: str, samples: list[str]) -> list[float]:
    return values(samples, _pairs(spark, path))


def normalisation_factors(spark: SparkSession, path: str, samples: list[str]) -> list[float]:
    """One factor for each sample, split by white space, in the columns' order."""
    out = [float(x) for row in spark.read.text(path).collect() for x in row[0].split()]
    if len(out) != len(samples):
        raise ValueError(f"{len(out)} factors for {len(samples)} samples")
    return out
