"""Tunables, passed explicitly to each job so that a plan never depends on the environment."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TriageConfig:
    # Provider scales: points per malicious vendor vote and per threat pulse.
    vt_vote_weight: int = 20
    otx_pulse_weight: int = 10
    otx_error_scores_zero: bool = True

    # Verdict cut-offs on the mean 0..100 score, and on the vendor count for file hashes.
    verdict_malicious: int = 50
    verdict_suspicious: int = 20
    hash_malicious_vendors: int = 3
    hash_suspicious_vendors: int = 1

    # Priority score.
    severity_weight: int = 6
    repeat_points: int = 3
    repeat_cap: int = 20
    enrichment_boost_multiplier: int = 2
    mitre_match_bonus: int = 5
    verdict_boost: dict[str, int] = field(
        default_factory=lambda: {
            "malicious": 4,
            "suspicious": 2,
            "clean": 0,
            "unknown": 0,
            "private/internal": 0,
        }
    )
    consensus_bonus: dict[str, int] = field(
        default_factory=lambda: {"strong": 6, "mixed": 3, "weak": 1, "unknown": 0}
    )

    # Tier cut-offs.
    tier_p1: int = 80
    tier_p2: int = 55
    tier_p3: int = 30

    # Freshness.
    reputation_ttl_seconds: int = 3600
    attack_bundle_ttl_seconds: int = 7 * 24 * 3600

    # Dedup.
    dedup_window_minutes: int = 60
    dedup_fuzzy_threshold: float = 0.90
    # Order in which alerts meet groups: "input" (by seq), or "time" (as if sorted by time first,
    # which never needs a row-by-row pass).
    dedup_order: str = "input"

    # Year given to timestamps that carry none (classic syslog). A fixed value keeps reruns equal.
    reference_year: int = 2024
    # Send timestamps the built-in parser does not know through dateutil (Arrow batches).
    lenient_timestamps: bool = True

    # Physical bounds.
    # A key with so many rows is hot: a join deals its rows out over this many tasks.
    hot_key_rows: int = 1_000_000
    join_salts: int = 16
    # Rows per (key, sequence block) in ordered scans and per task in ordered grouping.
    block_rows: int = 500_000
    # Ids per part of a group's member list.
    member_part_rows: int = 100_000

    @property
    def window_micros(self) -> int:
        return self.dedup_window_minutes * 60 * 1_000_000
