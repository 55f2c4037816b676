"""Run options and their domain checks."""

from __future__ import annotations

from dataclasses import dataclass

#: Plans of the plain table.
PLACEMENTS = ("direct", "wide_decimal", "conditional_sums", "morsel_partials", "vector_preaggregate")


@dataclass(frozen=True)
class RunOptions:
    """What a pricing-summary run can vary. The answer never depends on it."""

    data_dir: str = "/root/testdata"
    scale_factor: float = 0.01
    runs: int = 5
    plan: str = "direct"
    apply_compression: bool = False
    use_filter_pushdown: bool = False
    use_coprocessing: bool = False
    cpu_fraction: float = 0.5
    rows_per_launch: int = 2**21
    print_results: bool = False
    results_csv: str | None = None

    def __post_init__(self) -> None:
        if self.scale_factor < 0.001:
            raise ValueError("scale factor must be at least 0.001")
        if self.runs <= 0:
            raise ValueError("runs must be positive")
        if not 0.0 <= self.cpu_fraction <= 1.0:
            raise ValueError("cpu fraction must lie in [0, 1]")
        if self.rows_per_launch <= 0:
            raise ValueError("rows per launch must be positive")
        if self.plan not in PLACEMENTS:
            raise ValueError(f"unknown plan {self.plan!r}; one of {', '.join(PLACEMENTS)}")
        if self.use_filter_pushdown and not self.apply_compression:
            raise ValueError("the filter bitmap needs compressed columns")
        if self.plan != "direct" and (self.apply_compression or self.use_filter_pushdown or self.use_coprocessing):
            raise ValueError(f"plan {self.plan!r} works on the plain table in one part")

    @property
    def sf_dir(self) -> str:
        return f"{self.data_dir}/sf{self.scale_factor:g}"
