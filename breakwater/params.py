"""Scalar settings shared by the operators, with their documented defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    # depth limits
    mean_cov: float = 50.0
    max_cn: int = 10
    # read counting
    threshold: int = 6
    norm_overlap: int = 10
    count_sc_len: int = 6
    sc_len: int = 10
    # variant classes
    gain_classes: tuple[str, ...] = ("DUP", "INTDUP")
    # caller-table scan
    min_mapq: int = 20
    repeat_classes: tuple[str, ...] = ("Satellite", "Simple_repeat")
    # filtering
    neutral: bool = False
    size_filter: int = -1
    min_dep: int = 8
    min_span: int = 1
    min_split: int = 1
    filter_outliers: bool = False
    filter_chroms: bool = False
    filter_subclonal_cnvs: bool = False
    strict_cnv: bool = True
    germline_threshold: int = 10
    germline_min_support: int = 0
    support_adjust_factor: float = 0.0
    sv_offset: int = 100_000
    chroms: tuple[str, ...] = field(
        default_factory=lambda: tuple(str(i) for i in range(1, 23)) + ("X", "Y")
    )
    # classification
    insertion_distance: int = 15
    neighbour_distance: int = 100
    pair_distance: int = 15
    # clustering
    repeat: int = 5
    n_iter: int = 1000
    clus_limit: int = 6
    adjusted: bool = True
    male: bool = True


DEFAULTS = Params()

# Tags that take an SV out of read counting (fixed values).
SKIP_TAGS = ("BLACKLIST", "UNKNOWN_DIR", "HIDEP", "MIXED", "READ_FETCH_FAILED")

# Per-sample values used where a sample is not in the given tables (fixed values).
DEFAULT_PURITY = 1.0
DEFAULT_PLOIDY = 2.0
DEFAULT_READ_LEN = 100
DEFAULT_INSERT_MEAN = 300.0
DEFAULT_INSERT_STD = 20.0
PARAM_DEFAULTS = {
    "purity": DEFAULT_PURITY,
    "ploidy": DEFAULT_PLOIDY,
    "read_len": DEFAULT_READ_LEN,
    "insert_mean": DEFAULT_INSERT_MEAN,
    "insert_std": DEFAULT_INSERT_STD,
}
