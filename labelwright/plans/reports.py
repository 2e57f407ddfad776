"""Markdown of small results; what is collected here has a row per label, trap or cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _table(head: list[str], rows: list[list[object]]) -> str:
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(head), line(["---"] * len(head)), *map(line, rows)])


def drift_report(verdict: DataFrame, rows: DataFrame) -> str:
    """The verdict of one batch and the shares by label."""
    v = verdict.first()
    shares = [[r["label"], f"{r['expected']:.3f}", f"{r['actual']:.3f}", f"{r['actual'] - r['expected']:+.3f}"] for r in rows.orderBy("label").collect()]
    return f"# Drift report\n\nPSI {v['psi']:.4f}, chi-square p {v['p_value']:.4f}: **{v['level']}**{' (alert)' if v['alert'] else ''}\n\n" + _table(["label", "baseline", "incoming", "change"], shares) + "\n"


def adversarial_report(traps: DataFrame, overall: DataFrame) -> str:
    whole = overall.first()
    rows = traps.orderBy("first").collect()
    body = _table(["trap", "n", "correct", "accuracy", "held"], [[r["trap_type"], r["n"], r["correct"], f"{r['accuracy']:.3f}", "yes" if r["held"] else "no"] for r in rows])
    weak = next((r for r in rows if r["trap_type"] == whole["weakest"]), None)
    misses = "\n".join(f"- {m['case_id']}: intended {m['intended']}, predicted {m['predicted']}; {m['why_hard']}" for m in (weak["misses"][:6] if weak else []))
    return f"# Adversarial report\n\nOverall {whole['correct']}/{whole['n']} = {whole['accuracy']:.3f}; weakest: {whole['weakest']}\n\n{body}\n\n## Misses of the weakest trap\n\n{misses}\n"


def taxonomy_report(clusters: DataFrame, ari: DataFrame, purity: DataFrame) -> str:
    p = purity.first()
    body = _table(["cluster", "size", "name", "exemplar"], [[r["cluster"], r["size"], r["name"], (r["exemplars"] or [""])[0]] for r in clusters.orderBy("cluster").collect()])
    return f"# Disagreement taxonomy\n\nARI {ari.first()['ari']}, mean purity {p['mean_purity']} over {p['n_clusters']} clusters, {p['n_noise']} noise\n\n{body}\n"


def metrics_report(metrics: DataFrame) -> str:
    rows = metrics.orderBy("metric").collect()
    ci = lambda r: f"[{r['ci_lo']:.3f}, {r['ci_hi']:.3f}]" if r["ci_lo"] is not None else ""
    return "# Agreement\n\n" + _table(["metric", "value", "95 %", "n"], [[r["metric"], f"{r['value']:.3f}", ci(r), f"{r['n']:,}"] for r in rows]) + "\n"
