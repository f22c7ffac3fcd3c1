"""Parameters of episode mining and their text codes."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default band limits in Hz, half open.
BANDS = {"Delta": (0.5, 4.0), "Theta": (4.0, 8.0), "Alpha": (8.0, 13.0), "Beta": (13.0, 30.0)}
# Epoch classes and the label each carries.
EPOCH_TYPES = {"faw": 0, "awake": 1, "normal_an": 2}
KEYS = ["case_id", "start", "end"]


@dataclass(frozen=True)
class EpisodeParams:
    """The seven values that identify one epoch table."""

    bis_threshold: float = 70
    mac_threshold: float = 0.8
    min_episode_length: int = 20
    refractory_time: float = 5
    merged_episodes: bool = False
    fixed_window_size: int = 20
    overlap: float = 0.0

    def as_dict(self) -> dict:
        return asdict(self)

    def result_code(self, prefix: str = "result") -> str:
        mac = f"{self.mac_threshold:.2f}".replace(".", "")
        return f"{prefix}_{self.bis_threshold:g}_{mac}_{self.min_episode_length}_{self.refractory_time:g}"

    def window_code(self) -> str:
        stem = "Summary_Merged_Episodes" if self.merged_episodes else "Summary_Episodes"
        share = f"{self.overlap:.2f}".replace(".", "")
        return f"{stem}_{self.fixed_window_size}_{share}"


def _with_point(digits: str) -> float:
    return float(digits[0] + "." + digits[1:])


def parse_codes(result_code: str, window_code: str) -> EpisodeParams:
    """Inverse of the two codes; the decimal point goes after the first digit (``080`` is 0.80)."""
    r = re.fullmatch(r".*?_(\d+)_(\d+)_(\d+)_(\d+)", result_code)
    w = re.fullmatch(r"Summary_(Merged_)?Episodes_(\d+)_(\d+)", window_code)
    if not r or not w:
        raise ValueError(f"not a parameter code: {result_code!r}, {window_code!r}")
    return EpisodeParams(
        float(r[1]), _with_point(r[2]), int(r[3]), float(r[4]), w[1] is not None, int(w[2]), _with_point(w[3])
    )


def code_column(prefix: str, bis: Column, mac: Column, min_len: Column, refractory: Column) -> Column:
    """``result_70_080_20_5`` from parameter columns."""
    digits = F.regexp_replace(F.format_string("%.2f", mac.cast("double")), r"\.", "")
    return F.concat_ws("_", F.lit(prefix), bis.cast("long"), digits, min_len.cast("long"), refractory.cast("long"))


def parse_code_column(code: Column) -> Column:
    """Struct of the four numbers in a result code column."""
    pattern = r"_(\d+)_(\d+)_(\d+)_(\d+)$"
    mac = F.regexp_extract(code, pattern, 2)
    pointed = F.concat(F.substring(mac, 1, 1), F.lit("."), F.substring(mac, 2, 20))
    return F.struct(
        F.regexp_extract(code, pattern, 1).cast("double").alias("bis_threshold"),
        pointed.cast("double").alias("mac_threshold"),
        F.regexp_extract(code, pattern, 3).cast("long").alias("min_episode_length"),
        F.regexp_extract(code, pattern, 4).cast("double").alias("refractory_time"),
    )
