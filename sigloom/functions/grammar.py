"""Small grammars of settings: value ranges, context grids, metrics, confounders. All are read on the driver."""

from __future__ import annotations

from dataclasses import dataclass

METRICS = ("tpr_at_fpr", "callable_at_precision")
CONFOUND_KINDS = ("disc_base", "identity", "lookup")


def values(text: str) -> list[int]:
    """`a:b:s` (b included), `a,b,c` or one number."""
    if ":" in text:
        parts = [int(p) for p in text.split(":")]
        if len(parts) != 3 or parts[2] <= 0 or parts[0] > parts[1]:
            raise ValueError(f"not start:stop:step with a positive step: {text!r}")
        return list(range(parts[0], parts[1] + 1, parts[2]))
    return [int(p) for p in text.split(",")]


def context_grid(both: str | None = None, left: str | None = None, right: str | None = None) -> list[tuple[int, int]]:
    """All (left, right) of the two lists; `both` stands for either list that isn't given."""
    if not (left or both) or not (right or both):
        raise ValueError("each side needs values")
    return [(a, b) for a in values(left or both) for b in values(right or both)]


def metric(text: str) -> tuple[str, float]:
    """`kind:number` of a metric with a parameter."""
    kind, _, number = text.partition(":")
    if kind not in METRICS:
        raise ValueError(f"no metric {kind!r}; there are {', '.join(METRICS)}")
    return kind, float(number)


def selection_metric(text: str, classes: int) -> str:
    """auto: f1 for more than two classes, else the area under the curve; metrics with a parameter are for two."""
    if text == "auto":
        return "val_f1" if classes > 2 else "val_auc"
    if ":" in text:
        metric(text)
        if classes > 2:
            raise ValueError(f"{text!r} is for two classes")
    return text


@dataclass(frozen=True)
class Confound:
    source: str
    kind: str
    table: str | None = None


def confound(text: str) -> Confound:
    """`source:kind` or `source:lookup:table`."""
    parts = text.split(":")
    if len(parts) not in (2, 3) or parts[1] not in CONFOUND_KINDS or (parts[1] == "lookup") != (len(parts) == 3):
        raise ValueError(f"not source:kind[:table]: {text!r}")
    return Confound(*parts)


def amino_acid(header: str) -> str:
    """The second part of a reference's name, `tRNA-Ala-AGC-1`."""
    parts = header.split("-")
    if len(parts) < 3 or parts[0] != "tRNA":
        raise ValueError(f"not a reference name: {header!r}")
    return parts[1]


def feature_window(start: int | None, end: int | None, context: int) -> tuple[int, int]:
    """Missing ends are the context's; 0 is a value."""
    return (-context if start is None else start, context if end is None else end)


def kmer_slice(context: int, feature_start: int, offset: int, kmer: int, width: int) -> tuple[int, int]:
    """Columns of a feature window that a model's k-mer takes."""
    start = -context - feature_start + offset
    if start < 0 or start + kmer > width:
        raise ValueError(f"columns {start}..{start + kmer} are outside a window of {width}")
    return start, start + kmer


def exclusive(**options: object) -> None:
    """At most one option is set."""
    if len(given := [k for k, v in options.items() if v]) > 1:
        raise ValueError(f"options exclude each other: {', '.join(given)}")
