"""Two-snapshot reconciliation from raw tables to result tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import bands, outputs, pair_audits, review, sanity, summaries
from ..operators.dedupe import dedupe_best
from ..operators.gate import gate
from ..operators.match import MatchResult, pair_rows, tiered_match
from ..operators.resolve import Resolution, resolve_one_to_one
from ..operators.waves import wave_dates
from ..policy import extra_fields, load_policy
from ..sources.sinks import append_audit_trail, write_partitioned_queue, write_table
from ..sources.snapshots import ROW, map_columns, mapping_report, require_columns
from ..sources.staging import materialize


@dataclass
class ReconResult:
    """Stored pairs and decisions, and every table that follows from them."""

    mapped_old: DataFrame
    mapped_new: DataFrame
    match: MatchResult
    resolution: Resolution
    pairs: DataFrame
    gated: DataFrame
    sanity: dict
    policy: dict
    as_of: str
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def outputs(self) -> dict[str, DataFrame]:
        """Lazy result tables by name; corrections only when the sanity gate lets them out."""
        g, pairs = self.gated, outputs.strip_pii(self.pairs, self.policy)
        review = outputs.friendly_review(g, self.policy)
        result = {
            "wide_compare": outputs.wide_compare(g, self.policy),
            "lookup_keys": outputs.lookup_keys(pairs),
            "review_queue": outputs.review_queue(g, self.policy),
            "review_needed": outputs.review_needed(g),
            "held_corrections": outputs.held_corrections(g),
            "friendly_review": review,
            "identity_conflicts": outputs.identity_conflicts(
                review, self.resolution.conflicts_old.unionByName(self.resolution.conflicts_new)),
            "unmatched_old": self.match.unmatched_old,
            "unmatched_new": self.match.unmatched_new,
            "conflicts_old": self.resolution.conflicts_old,
            "conflicts_new": self.resolution.conflicts_new,
            "skipped_missing": self.resolution.skipped_missing,
            "salary_delta_buckets": sanity.salary_delta_buckets(pairs),
            "hire_date_buckets": sanity.hire_date_buckets(pairs),
            "suspicious_defaults": sanity.suspicious_defaults(pairs),
            "match_source_summary": pair_audits.match_source_summary(pairs),
            "run_overview": summaries.run_overview(g, self.policy),
            "run_findings": summaries.run_findings(g),
        }
        for group in pair_audits.PAIR_GROUPS:
            result[f"mismatch_{group}"] = pair_audits.mismatches(pairs, group, "blank_counts")
        result |= self.tables | self._input_checks() | self._pair_audits(pairs) | self._gate_reports()
        result |= self._review_candidates()
        result["run_stats"] = summaries.run_stats(
            g, review, result["identity_conflicts"], self.match.unmatched_old, self.match.unmatched_new, self.sanity)
        if not self.sanity["blocked_outputs"]["corrections"]:
            for kind in outputs.CORRECTIONS:
                result[f"corrections_{kind}"] = outputs.corrections(g, kind, self.as_of)
            result["corrections_manifest"] = outputs.enhance_manifest(outputs.corrections_manifest(g))
        return result

    def _input_checks(self) -> dict[str, DataFrame]:
        old, new = self.mapped_old, self.mapped_new
        return {
            "preflight_repeats": pair_audits.preflight(old, new, self.pairs),
            "preflight_warnings": summaries.preflight_warnings(old, new),
        }

    def _pair_audits(self, pairs: DataFrame) -> dict[str, DataFrame]:
        result = {
            "hire_date_mismatch_by_prefix": pair_audits.hire_date_mismatch_by_prefix(pairs),
            "salary_variance": pair_audits.salary_variance(pairs),
            "salary_delta_distribution": pair_audits.salary_delta_distribution(pairs),
            "salary_ratio_clusters": pair_audits.salary_ratio_clusters(pairs),
            "extreme_salary_shifts": pair_audits.extreme_shifts(pairs),
            "extreme_ratio_bins": pair_audits.extreme_ratio_bins(pairs),
            "roles_with_extremes": pair_audits.roles_with_extremes(pairs),
            "payrate_alignment": pair_audits.payrate_alignment(pairs),
            "same_role_extremes": pair_audits.same_role_extremes(pairs),
            "same_role_ratio": pair_audits.same_role_ratio(pairs),
            "wave_summary": pair_audits.wave_summary(pairs),
            "wave_top_dates": pair_audits.top_new_dates(pairs),
            "wave_rows": pair_audits.wave_rows(pairs),
            "salary_anomalies": pair_audits.salary_anomalies(pairs),
            "salary_anomaly_summary": pair_audits.salary_anomaly_summary(pairs),
            "salary_anomalies_by_district": pair_audits.salary_anomalies_by(pairs, "new_district"),
            "salary_anomalies_by_position": pair_audits.salary_anomalies_by(pairs, "new_position"),
            "default_date_causes": sanity.default_date_causes(pairs, self.policy),
            "default_date_samples": sanity.default_date_samples(pairs, self.policy),
        }
        return result | {f"mismatch_pack_{p}": pair_audits.mismatch_pack(pairs, p) for p in pair_audits.PACKS}

    def _gate_reports(self) -> dict[str, DataFrame]:
        g = self.gated
        return {
            "ui_pairs": outputs.ui_pairs(g, self.policy),
            "sanity_gate": sanity.verdict_table(g.sparkSession, self.sanity),
            "gate_by_fix_type": summaries.gate_by_fix_type(g),
            "gate_by_source": summaries.gate_by_source(g),
            "salary_report": summaries.salary_report(g),
            "recommendations": summaries.recommendations(g),
        }

    def _review_candidates(self) -> dict[str, DataFrame]:
        """Likely partners of the unmatched rows: pairs, and members where a key repeats on both sides."""
        old, new = self.match.unmatched_old, self.match.unmatched_new
        return {
            "review_candidates": review.review_candidates_tiered(old, new),
            "review_candidate_groups": review.grouped_candidates(old, new),
            "review_pairs": review.review_pairs_last4(old, new),
            "review_pair_groups": review.grouped_evidence(old, new),
        }

    def write(self, path: str, run_id: str, fmt: str = "parquet") -> None:
        for name, df in self.outputs().items():
            write_table(outputs.strip_pii(df, self.policy), f"{path}/{name}", fmt)
        write_partitioned_queue(outputs.review_queue(self.gated, self.policy, ordered=False), f"{path}/review_by_department")
        append_audit_trail(outputs.audit_trail(self.gated, self.as_of), f"{path}/audit_trail", run_id)


def map_snapshot(raw: DataFrame, policy: dict, aliases: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row per id, mapping report), canonical columns.

    Stored before and after the rows of repeated ids are dropped: the dedupe
    reads its input several times, and the later steps read its result.
    """
    require_columns(raw, [ROW], "snapshot")
    mapped = materialize(map_columns(raw, extra_fields(policy), aliases), "mapped")
    return materialize(dedupe_best(mapped.drop("salary_raw")), "snapshot"), mapping_report(mapped)


def reconcile(
    old: DataFrame, new: DataFrame, as_of: str, policy: dict | None = None, aliases: dict | None = None,
    band_table: DataFrame | None = None, allow_blank_id: bool = False, method: str = "sequence",
) -> ReconResult:
    """Map, match, resolve, decide. ``old`` and ``new`` carry ``src_ord`` (see ``read_snapshot``).

    Stored on the way: both mapped snapshots, before and after the dedupe, the
    links, the pairs and the decisions. All outputs are lazy frames over these.
    """
    policy = load_policy(policy)
    (mapped_old, report_old), (mapped_new, report_new) = (map_snapshot(s, policy, aliases) for s in (old, new))
    reports = {"mapping_report_old": report_old, "mapping_report_new": report_new}
    match = tiered_match(mapped_old, mapped_new, allow_blank_id=allow_blank_id)
    candidates = pair_rows(match, mapped_old, mapped_new, extra_fields(policy), method=method)
    resolution = resolve_one_to_one(materialize(candidates, "candidates"))
    pairs = materialize(resolution.pairs, "pairs")
    pair_audits.require_one_to_one(pairs)
    decided = gate(pairs, policy, wave_dates(pairs))
    if band_table is not None:
        decided = bands.comp_band_annotate(decided, bands.load_bands(band_table))
    gated = materialize(decided, "gated")
    verdict = sanity.evaluate_sanity_gate(sanity.collect_metrics(pairs, gated), policy)
    return ReconResult(mapped_old, mapped_new, match, resolution, pairs, gated, verdict, policy, as_of, reports)
