"""SQL fragments for the checker, written against its RE2 dialect.

RE2 word classes are ASCII only, so Latin letters are folded to ``z`` first; that keeps
word boundaries where the engine's Unicode classes put them.
"""

from __future__ import annotations

from feedloom.fixed_values import ARTIFACT_PATTERNS as A
from feedloom.fixed_values import CHECK_PATTERNS as C
from feedloom.fixed_values import DETECTOR_PATTERNS as D
from feedloom.plans import adapters


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re(text: str, pattern: str, ignore_case: bool = True) -> str:
    return f"regexp_matches({text}, {lit(('(?i)' if ignore_case else '') + pattern)})"


def fold(text: str) -> str:
    return f"regexp_replace({text}, '[À-ÖØ-öø-ÿĀ-ž]', 'z', 'g')"


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {lit(pattern)}))"


def any_of(text: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(re(text, p) for p in patterns) + ")"


def in_list(column: str, values: list[str]) -> str:
    return f"{column} IN (" + ", ".join(lit(v) for v in values) + ")"


def weak(t: str) -> str:
    return (
        f"(contains({t}, '```') OR {re(t, A['url'], False)} OR {re(t, A['path'])} OR {re(t, A['file_name'])}"
        f" OR {re(t, A['exit_or_verdict'])} OR ({re(t, A['any_count'])} AND {re(t, A['count_context'])}))"
    )


def tool_backed(t: str) -> str:
    return (
        f"(len(string_split({t}, '```')) >= 3 OR {re(t, A['url'], False)} OR {re(t, A['exit_number'])}"
        f" OR ({re(t, A['pass_fail_count'])} AND {re(t, A['runner'])})"
        f" OR ({re(t, A['metric_count'])} AND {re(t, A['metric_tool'])})"
        f" OR ({re(t, A['named_tool'])} AND ({re(t, A['output_word'])} OR contains({t}, '```'))))"
    )


def strong(t: str) -> str:
    rows = (
        f"len(list_filter(string_split({t}, chr(10)), lambda x: regexp_matches(x, '^\\s*\\|') AND NOT contains(x, '---')))"
    )
    return (
        f"({tool_backed(t)} OR ({rows} >= 3 AND {re(t, A['table_identifier'])})"
        f" OR ({count(t, A['bullet'])} >= 2 AND {count(t, A['code_token'])} >= 2) OR {re(t, A['tests_narrative'])})"
    )


def _checks(t: str) -> list[tuple[str, str, str, str]]:
    """(id, pattern, gate SQL, test SQL) of every check."""
    m = lambda name: re(t, C[name])
    w, s, r = "_w", "_s", "_r"
    tagged = m("tagged_uncertain")
    return [
        ("completion_without_artifact", "unverified_completion", m("claim"), s),
        ("hedge_without_verification", "unverified_claims", m("hedge"), w),
        ("posting_claim_without_trace", "acting_without_permission", m("post"), w),
        ("sql_without_dry_run", "no_dry_run_sql", m("bq_exec"), m("dry_run")),
        ("confident_agreement_without_verification", "incomplete_analysis", f"{m('agree')} AND {m('technical_claim')}", w),
        ("scope_dismissal_without_research", "incomplete_analysis", m("dismiss_scope"), f"{r} OR {w}"),
        ("premature_certainty_without_trace", "incomplete_analysis", m("premature_certainty"), f"{r} OR {w} OR {s}"),
        ("conclusion_without_evidence", "incomplete_analysis", m("conclusion_claim"), f"{r} OR {w} OR {s}"),
        ("retry_without_diagnosis", "blind_retry", m("retry"), m("diagnosis")),
        ("jira_mcp_used", "tool_misuse", m("jira_mcp"), "false"),
        ("wrong_tool_admission", "tool_misuse", m("wrong_tool"), m("wrong_tool_recovery")),
        ("duplicate_approval_claimed", "duplicate_approval", m("dup_approve"), "false"),
        ("pr_approve_without_status", "pr_review_failure", m("pr_approve"), f"{m('pr_status_trace')} OR {w}"),
        ("review_post_without_fresh_diff", "stale_context", f"{m('inline_review')} AND {m('post')}", m("diff_fresh")),
        ("global_scope_without_confirm", "scope_misunderstanding", m("scope_global"), m("scope_confirm")),
        ("stale_analysis_continued", "stale_context", m("stale_act"), f"{m('diff_fresh')} OR {w}"),
        ("external_post_without_ask", "posted_without_approval", m("post_without_ask"), m("ask_before_post")),
        ("fix_claim_without_regression_check", "regression_introduction", m("regression_claim"), f"{m('regression_test')} OR {w}"),
        ("extra_rec_without_scope_label", "redundant_recommendation", m("redundant_rec"), m("scope_only")),
        ("confident_state_without_evidence", "unverified_claims", f"{m('confident_state')} AND NOT {tagged}", s),
        ("metric_without_evidence", "unverified_claims", f"{m('metric_claim')} AND NOT {tagged}", s),
        ("bare_metric_not_strong_artifact", "unverified_completion", f"{m('claim')} AND {m('metric_claim')}", s),
        ("verify_badge_without_evidence", "unverified_completion", m("verify_badge"), s),
        ("change_badge_without_proof", "unverified_completion", f"({m('change_badge')} OR {re(t, A['hotfix'])})", s),
        ("correction_without_reverify", "unverified_claims", f"{m('self_correction')} AND {m('confident_state')} AND NOT {tagged}", s),
        ("approve_without_verification_trace", "approved_without_verification", m("approve_claim"), m("approve_verify")),
        ("unhelpful_troubleshooting_no_diagnosis", "unhelpful_troubleshooting", m("unhelpful_trouble"), m("trouble_diagnosis")),
        ("explicit_instruction_ignored", "explicit_instruction_violation", m("instruction_forbid"), m("instruction_honor")),
        ("setup_claim_without_dep_resolve", "missing_dependency", m("setup_or_dep_claim"), m("dep_resolve_proof")),
        ("airflow_retry_without_upstream_check", "airflow_blind_retry", m("airflow_retry_act"), m("airflow_upstream_diag")),
    ]


def fired(source: str, text: str, keep: str) -> str:
    """SELECT of the fired checks over relation ``source``."""
    base = (
        f"SELECT {keep}, _t, {weak('_t')} AS _w, {strong('_t')} AS _s, {re('_t', C['research_trace'])} AS _r"
        f" FROM (SELECT *, {fold(text)} AS _t FROM {source})"
    )
    arms = [
        f"SELECT {keep}, {lit(i)} AS eval_id, {lit(p)} AS pattern, ({test}) AS passed FROM _scored WHERE ({gate})"
        for i, p, gate, test in _checks("_t")
    ]
    return f"(WITH _scored AS ({base}) " + " UNION ALL ".join(arms) + ")"


def detector_fires(t: str) -> list[tuple[str, str]]:
    """(pattern, SQL condition) of each stop-time detector."""
    c = lambda n: re(t, C[n])
    d = lambda n: re(t, D[n])
    return [
        ("unverified_completion", f"{d('completion_claim')} AND NOT {tool_backed(t)}"),
        ("incomplete_analysis", f"(({c('agree')} AND {c('technical_claim')}) OR {d('dismiss')}) AND NOT ({weak(t)} OR {d('research')})"),
        ("unverified_claims", f"((({c('confident_state')}) OR ({c('metric_claim')})) AND NOT {tool_backed(t)} AND NOT {c('tagged_uncertain')}) OR ({c('hedge')} AND NOT {weak(t)})"),
        ("duplicate_approval", c("dup_approve")),
        ("blind_retry", f"{c('retry')} AND NOT {c('diagnosis')}"),
        ("tool_misuse", c("jira_mcp")),
        ("guardrail_bypass", f"{d('guardrail_named')} AND {d('guardrail_skipped')}"),
    ]


def taxonomy_values() -> str:
    rows = ", ".join(f"({lit(p)}, {lit(k)})" for p, ks in adapters.TAXONOMY.items() for k in ks)
    return f"(VALUES {rows}) AS t(pattern, keyword)"


# Ratings with one row per (rating, pattern); unmatched rows carry 'other'.
RATINGS_CTE = f"""r AS ({adapters.RATINGS}),
cls AS (SELECT r.event_id, t.pattern FROM r JOIN {taxonomy_values()}
  ON contains(lower(concat_ws(' ', sentiment_summary, '', response_preview, skill, tool, '', repo)), t.keyword)
  GROUP BY ALL),
rp AS (SELECT r.*, coalesce(cls.pattern, 'other') AS pattern FROM r LEFT JOIN cls USING (event_id))"""


def verdict(before: str, after: str, n: str, days: str) -> str:
    return (
        f"CASE WHEN {n} < 5 AND {days} >= 14 THEN 'stale-pending' WHEN {n} < 5 THEN 'pending'"
        f" WHEN {before} = 0 THEN 'no-baseline' WHEN {after} = 0 THEN 'resolved'"
        f" WHEN {after} <= {before} * 0.5 THEN 'working' WHEN {after} < {before} THEN 'improving'"
        f" WHEN {after} <= {before} * 1.2 THEN 'flat' ELSE 'regressed' END"
    )
