"""Declared schemas of the log tables."""

RATINGS = """
timestamp string, rating string, session_id string, source string, sentiment_summary string, confidence double,
response_preview string, comment string, tools_used array<string>, files_touched array<string>, repo string,
skill string, skill_candidates array<string>, agent string,
eval_results map<string, struct<passed: boolean, pattern: string>>
"""
RECLASS = "session_id string, timestamp string, patterns array<string>"
CHECK_RESULTS = "timestamp string, session_id string, rating int, eval_id string, pattern string, passed boolean"
JUDGE_RESULTS = """
timestamp string, session_id string, pattern string, passed boolean, evidence string, skill string, repo string,
source string
"""
REVIEW_QUEUE = """
pattern string, detected_at string, delta double, after_n int, obj_verdict string, judge_verdict string,
status string, reviewed_at string, reviewer string, source string, note string, reason string
"""
REVIEW_AUDIT = """
timestamp string, pattern string, action string, reviewer string, reason string, delta double, after_n int
"""
ENFORCEMENT_LOG = "ts timestamp, session string, pattern string, mode string, blocked boolean"
SKILL_EDITS = """
skill string, pattern string, surface string, baseline_fail_rate double, baseline_n int, applied string,
status string, post_n int, verdict string
"""
PATTERN_CANDIDATES = """
session_id string, label string, labeled_at string, sentiment_summary string, rating int, status string
"""
LESSON_VARIANTS = """
pattern string, variant_id int, text string, failing_rule string, proposed_at string, status string
"""
EFFECTIVENESS_LOG = """
pattern string, lesson_date string, baseline_date string, verdict string, delta double, after_n int, measured_at string
"""
EPISODES = """
ts string, name string, episode_body string, source string, source_description string, group_id string,
status string, origin string
"""
EXPECTATION = "map<string, struct<applied: boolean, passed: boolean>>"
CASES = f"""
split string, cases array<struct<id: string, domain: string, pattern: string, response: string, expect: {EXPECTATION}>>
"""
SCENARIOS = f"""
scenarios array<struct<id: string, split: string, domain: string, pattern: string, user: string,
must_not_match: array<string>, must_match_any: array<string>, eval_expect: {EXPECTATION}>>
"""
TRANSCRIPT_LINE = "type string, cwd string, message struct<role: string, content: string>"
BLOCKS = """
array<struct<type: string, name: string, text: string, content: string, input: map<string, string>>>
"""
GRAPH = """
nodes array<struct<id: string, label: string, file_type: string, source_file: string, source_location: string>>,
links array<struct<source: string, target: string, relation: string, confidence: string, confidence_score: double>>,
edges array<struct<source: string, target: string, relation: string, confidence: string, confidence_score: double>>,
hyperedges array<struct<id: string, label: string, nodes: array<string>>>
"""
