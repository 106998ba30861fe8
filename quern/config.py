"""Thresholds of the detection rules."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

MIB = 1024 * 1024


@dataclass(frozen=True)
class Thresholds:
    """All knobs with their defaults; ``key`` names are the field names with dashes."""

    # fixed values: the defaults that users of the rules know
    sla_ms: int = 200
    full_gc_per_min: float = 1.0
    gc_window: int = 300
    heap_leak_min_collections: int = 3
    heap_leak_rise: float = 0.10
    thread_leak_threshold: int = 40
    thread_leak_growth: float = 1.25
    lock_waiters: int = 3
    stack_cluster: int = 5
    pool_starve_min_size: int = 4
    pool_starve_same_frame: float = 0.80
    throughput: float = 0.97
    cpu_hot_top_n: int = 3
    exception_threshold: int = 5
    histo_share: float = 0.35
    max_evidence: int = 6
    histo_top_min_leader_mb: int = 16
    histo_top_min_bag_mb: int = 32
    mat_min_mb: int = 8
    mat_share: float = 0.10
    container_min_instances: int = 50_000
    cpu_min_cores: float = 0.5
    cpu_min_elapsed_sec: float = 1.0
    pool_max_size: int = 100
    burst_min: int = 10
    burst_bucket_sec: int = 60
    leak_pinned_share: float = 0.85
    leak_stagnant_share: float = 0.02
    leak_stalled_floor: float = 0.40
    stall_min: int = 3
    gc_settle_sec: float = 60.0
    #: Count only String in the "bag" of HIS001, as an earlier tool's code did, instead of byte[] + char[] + String.
    compat_bag: bool = False

    def as_map(self) -> dict[str, str]:
        return {k.replace("_", "-"): str(v) for k, v in asdict(self).items() if k != "compat_bag"}

    def override(self, **values) -> Thresholds:
        """A copy with some knobs changed; keys may be written with dashes. Values of another type are converted."""
        known = asdict(self)
        changed = {}
        for key, value in values.items():
            name = key.replace("-", "_")
            if name not in known:
                raise KeyError(f"no threshold is named {key}")
            kind = type(known[name])
            number = kind(value)
            if not isinstance(number, bool) and number < 0:
                raise ValueError(f"{key} can't be negative")
            changed[name] = number
        return replace(self, **changed)
