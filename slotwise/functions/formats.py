"""Tags of settings, and values as tables show them."""

from __future__ import annotations

import math
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tag's keys, each in thousandths.
TAG = {"gate_min": "gmn", "gate_max": "gmx", "spread_low": "sl", "spread_high": "sh"}


def encode_tag(settings: dict[str, Column]) -> Column:
    """gmn24_gmx221_sl2_sh61 of four columns, half to even."""
    return F.concat_ws("_", *[F.concat(F.lit(key), F.bround(settings[name] * 1000).cast("int").cast("string")) for name, key in TAG.items()])


def decode_tag(tag: Column) -> dict[str, Column]:
    """The four settings of a tag; null where the tag lacks one."""
    return {name: F.nullif(F.regexp_extract(tag, rf"(?:^|_){key}([0-9]+)(?:_|$)", 1), F.lit("")).cast("double") / 1000 for name, key in TAG.items()}


def format_value(value: Any) -> str:
    """Floats with six significant digits, null and NaN as NA, lists and dicts by their values."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return "NA"
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, dict):
        return ", ".join(f"{k}={format_value(v)}" for k, v in value.items())
    if isinstance(value, list | tuple):
        return ", ".join(map(format_value, value))
    return str(value)


def markdown_table(header: list[str], rows) -> str:
    lines = [header, ["---"] * len(header), *[[format_value(v) for v in row] for row in rows]]
    return "\n".join(f"| {' | '.join(line)} |" for line in lines)


def latex_table(header: list[str], rows) -> str:
    """A tabular; what LaTeX takes for a command is escaped."""

    def cell(text: str) -> str:
        return re.sub(r"([&%$#_{}])", r"\\\1", text.replace("\\", r"\textbackslash "))

    body = [" & ".join(map(cell, line)) + r" \\" for line in [header, *[[format_value(v) for v in row] for row in rows]]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(header)}}}", r"\hline", body[0], r"\hline", *body[1:], r"\hline", r"\end{tabular}"])
