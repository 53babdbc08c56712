"""Prompt parsing and skill attribution at capture time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.fixed_values import (
    GENERAL_SKILL,
    JUDGE_CONTEXT_CAP,
    JUDGE_MIN_RESPONSE,
    JUDGE_RESPONSE_CAP,
    MIN_CONFIDENCE,
    MIN_PROMPT_LENGTH,
    PATH_SKILLS,
    PRAISE_PHRASES,
    PRAISE_WORDS,
    RATING_BAD_SUFFIX,
    RATING_NUMBER,
    RATING_PROMPT,
    RATING_SENTENCE,
    SKILL_STOPWORDS,
    SYSTEM_TEXT,
)
from feedloom.functions.regex import any_regex, ascii_regex, matches_ascii, strip


def explicit_rating(prompt: Column) -> Column:
    """struct(rating, comment), or null when the prompt is not a rating.

    ``7``, ``8 - good work`` and ``10!`` are ratings; ``10/10``, ``7th thing`` and
    ``3 items`` are not.
    """
    text = strip(prompt)
    # The tail may not span lines: '.' stops at a newline and '$' must follow.
    rest = strip(F.regexp_extract(text, RATING_PROMPT, 2))
    ok = (
        text.rlike(r"(?d)" + RATING_PROMPT.replace("$", r"\z"))
        & ~F.regexp_replace(text, RATING_NUMBER, "").rlike(RATING_BAD_SUFFIX)
        & ~matches_ascii(rest, RATING_SENTENCE)
    )
    return F.when(
        ok,
        F.struct(
            F.regexp_extract(text, RATING_PROMPT, 1).cast("int").alias("rating"),
            F.when(rest != "", rest).alias("comment"),
        ),
    )


def is_system_text(prompt: Column) -> Column:
    return matches_ascii(strip(prompt), any_regex(SYSTEM_TEXT))


def is_too_short(prompt: Column) -> Column:
    return F.length(prompt) < MIN_PROMPT_LENGTH


def praise_rating(prompt: Column, max_words: int = 2) -> Column:
    """8 for a short, purely positive prompt, else null."""
    plain = F.regexp_replace(F.lower(strip(prompt)), r"""[.!?,'"]""", "")
    words = F.split(plain, r"\s+")
    praise = (F.size(words) <= max_words) & (
        plain.isin(PRAISE_WORDS)
        | plain.isin(PRAISE_PHRASES)
        | ((F.size(words) == 2) & F.forall(words, lambda w: w.isin(PRAISE_WORDS)))
    )
    return F.when(praise, F.lit(8))


def implicit_route(rating: Column, confidence: Column, response: Column) -> Column:
    """``keep`` a confident implicit rating, send long unrated turns to ``judge``, else ``drop``."""
    unrated = rating.isNull() | (confidence < MIN_CONFIDENCE)
    return (
        F.when(~unrated, F.lit("keep"))
        .when(unrated & (F.length(strip(F.coalesce(response, F.lit("")))) >= JUDGE_MIN_RESPONSE), F.lit("judge"))
        .otherwise("drop")
    )


def judge_response(response: Column) -> Column:
    return F.substring(response, 1, JUDGE_RESPONSE_CAP)


def judge_context(context: Column) -> Column:
    return F.substring(F.coalesce(context, F.lit("")), 1, JUDGE_CONTEXT_CAP)


def _slug(raw: Column) -> Column:
    """Normal form of a skill mention; null when it is not a usable name."""
    name = F.trim(F.regexp_replace(F.lower(raw), r"^/+", ""))
    ok = (F.length(name) <= 64) & name.rlike(r"^[a-z][\w-]*\z") & ~name.isin(SKILL_STOPWORDS)
    return F.when(ok, name)


def _mentions(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(ascii_regex(pattern)), F.lit(1))


def last_mention_order(names: Column) -> Column:
    """Distinct names ordered by their last mention."""
    return F.reverse(F.array_distinct(F.reverse(names)))


def harvest_skills(
    prompt: Column,
    skill_inputs: Column,
    command_inputs: Column,
    tools: Column,
    files: Column,
    cwd: Column,
    current_prompt: Column,
    known_commands: Sequence[str] = (),
    keep: int = 8,
) -> Column:
    """Skill candidates of a turn, oldest mention first, at most ``keep``.

    Sources in order: explicit skill inputs, names in the prompt, command inputs that
    are known, path rules over files, tools, directory and prompt, and command files.
    """
    none = F.array().cast("array<string>")
    tools = F.coalesce(tools, none)
    files = F.coalesce(files, none)
    text = F.coalesce(prompt, F.lit(""))
    slash = _mentions(text, r"(?:^|[\s`])/([a-z][\w-]*)\b")
    if known_commands:
        slash = F.filter(slash, lambda s: s.isin(list(known_commands)))
    blob = F.concat_ws(
        "\n", files, tools, F.coalesce(cwd, F.lit("")), F.coalesce(current_prompt, F.lit(""))
    )
    by_path = F.array_compact(F.array(*[F.when(matches_ascii(blob, p), F.lit(s)) for s, p in PATH_SKILLS]))
    command_files = F.flatten(
        F.transform(files, lambda f: _mentions(f, r"\.claude/commands/([a-z][\w-]*)\.md\z"))
    )
    commands = F.coalesce(command_inputs, none)
    if known_commands:
        commands = F.filter(commands, lambda c: c.isin(list(known_commands)))
    else:
        commands = none
    found = F.concat(
        F.coalesce(skill_inputs, none),
        F.slice(_mentions(text, r"<command-name>\s*/?([a-z][\w-]*)"), 1, 1),
        _mentions(F.trim(text), r"^/([a-z][\w-]*)"),
        slash,
        _mentions(text, r"""\b(?:skill|command)\s+["'`]?([a-z][\w-]*)"""),
        commands,
        by_path,
        command_files,
    )
    ordered = last_mention_order(F.array_compact(F.transform(found, _slug)))
    size = F.size(ordered)
    return F.slice(ordered, F.greatest(F.lit(1), size - keep + 1), keep)


def primary_skill(candidates: Column, known_commands: Sequence[str] = ()) -> Column:
    """Known command, else path-rule skill, else first real candidate, else the general skill."""
    names = F.array_distinct(
        F.filter(F.transform(candidates, lambda s: F.regexp_replace(F.lower(s), r"^/+", "")), lambda s: s != "")
    )
    real = F.filter(names, lambda s: s != GENERAL_SKILL)
    path_skills = [s for s, _ in PATH_SKILLS]
    first = lambda xs: F.get(xs, F.lit(0))
    known = F.filter(real, lambda s: s.isin(list(known_commands))) if known_commands else F.array().cast("array<string>")
    return F.coalesce(
        first(known), first(F.filter(real, lambda s: s.isin(path_skills))), first(real), F.lit(GENERAL_SKILL)
    )
