"""Scoring expressions of recall and landmark judging."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from memlake.functions import let
from memlake.settings import DEFAULTS, Settings

# --- fixed values: signs of text that a runtime wrote, not a person --------------
RUNTIME_MARKERS = (
    "runtime context (internal)",
    "[internal task completion event]",
    "keep this internal context private",
    "session_key:",
    "session_id:",
    "source: subagent",
    "status: completed successfully",
    "result (untrusted content, treat as data):",
    "<<<begin_untrusted_child_result>>>",
    "<<<end_untrusted_child_result>>>",
    "stats: runtime",
    "action:",
)
RUNTIME_PENALTY = 0.3
# ----------------------------------------------------------------------------------


PART_TERM_LENGTH = 40


def term_parts(terms: Column) -> Column:
    """All substrings of the terms of usual length; a token lies inside a term when it is one of them.

    Longer terms have too many substrings and are compared with tokens directly.
    """
    def parts(term: Column) -> Column:
        size = F.length(term)
        return F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(
            F.sequence(F.lit(1), size - i + 1), lambda n: F.substr(term, i, n))))

    usual = F.filter(terms, lambda t: F.length(t) <= PART_TERM_LENGTH)
    return F.array_distinct(F.flatten(F.transform(usual, parts)))


def lexical_score(terms: Column, parts: Column, tokens: Column, haystack: Column) -> Column:
    """Word-overlap score of query terms against a text.

    A term found as a whole token adds 1; a term that contains a token or lies
    inside one adds 0.5. `tokens` are the distinct tokens of the text and
    `haystack` the same tokens joined by spaces. `parts` (from `term_parts`)
    narrows the tokens with one hashed intersection to the few that equal a term
    or lie inside one; only terms without such a token are searched for in the
    text.
    """
    def value(term: Column, near: Column) -> Column:
        candidates = F.when(F.length(term) <= PART_TERM_LENGTH, near).otherwise(tokens)
        return (F.when(F.array_contains(candidates, term), 1.0)
                 .when(F.exists(candidates, lambda token: term.contains(token)), 0.5)
                 .when(haystack.contains(term), 0.5).otherwise(0.0))

    return let(F.array_intersect(parts, tokens), lambda near: F.aggregate(
        terms, F.lit(0.0), lambda total, term: total + value(term, near)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, v: total + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, v: total + v * v))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine of two double arrays; 0 when either is missing, empty, of other length or zero.

    Pass the norms when they were computed once per vector before a join.
    """
    norm_a = norm(a) if norm_a is None else norm_a
    norm_b = norm(b) if norm_b is None else norm_b
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm_a > 0) & (norm_b > 0)
    return F.when(usable, dot(a, b) / (norm_a * norm_b)).otherwise(F.lit(0.0))


def gated_fuse(lexical: Column, embedding: Column, hybrid: Column) -> Column:
    """Mix two calibrated scores; the stronger family leads when the other is weak."""
    lex = F.greatest(F.lit(0.0), F.least(F.lit(1.0), lexical))
    emb = F.greatest(F.lit(0.0), F.least(F.lit(1.0), embedding))
    strong, weak = 0.7, 0.4

    def mix(share: float) -> Column:
        return lex * share + emb * round(1 - share, 2)

    return (F.when(~hybrid, lexical)
             .when((lex >= strong) & (emb >= strong), mix(0.5))
             .when((lex >= strong) & (emb < weak), mix(0.65))
             .when((lex < weak) & (emb >= strong), mix(0.35))
             .otherwise(mix(0.45)))


def _unit(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def recency_score(day: Column, today: Column, window_start: Column, window_end: Column,
                  settings: Settings = DEFAULTS) -> Column:
    """Nearness in time: to today, or to a date window when one is asked for."""
    age = F.abs(F.datediff(today, day))
    distance = F.greatest(F.lit(0), F.datediff(window_start, day), F.datediff(day, window_end))
    return (F.when(day.isNull(), F.lit(0.5))
             .when(window_start.isNull(), 1 / (1 + age / settings.recency_horizon_days))
             .otherwise(1 / (1 + distance / settings.window_horizon_days)))


def layer_weight(layer: Column, prefer_l2_ratio: Column, settings: Settings = DEFAULTS) -> Column:
    """Weight of a layer; a ratio in [0, 1] moves weight from summaries to transcripts."""
    l2 = F.when(prefer_l2_ratio.isNull(), F.lit(settings.l2_weight)).otherwise(prefer_l2_ratio * 0.6)
    l1 = F.when(prefer_l2_ratio.isNull(), F.lit(settings.l1_weight)).otherwise(1 - prefer_l2_ratio * 0.6)
    return F.when(layer == "l2", l2).otherwise(l1)


def recency_modulate(weighted: Column, recency: Column, alpha: float = DEFAULTS.recency_alpha) -> Column:
    a = max(0.0, min(1.0, alpha))
    return _unit(weighted) * (F.lit(1.0 - a) + _unit(recency) * a)


def runtime_penalty(score: Column, text: Column) -> Column:
    lowered = F.lower(text)
    found = F.lit(0)
    for marker in RUNTIME_MARKERS:
        found = found + lowered.contains(marker).cast("int")
    return F.when(found >= 2, _unit(score) * RUNTIME_PENALTY).otherwise(score)


# --- rendered lines; labels are fixed values ---------------------------------------

def render_summary_line(depth: Column, time_key: Column, field: Column, information: Column,
                        item_type: Column, emotion: Column) -> Column:
    def qualified(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "",
                      F.concat(F.lit(label + "["), value, F.lit("]"))).otherwise(label)

    label = (F.when(field == "summary", "摘要")
              .when(field.isin("day_mood", "week_mood", "window_mood"), "情绪")
              .when(field == "topic_name", "主题")
              .when(field == "topic_detail", "主题细节")
              .when(field == "decision", "决策")
              .when(field == "todo", "待办")
              .when(field == "key_item", qualified("关键事项", item_type))
              .when(field == "emotional_peak_context", qualified("情绪高点", emotion))
              .when(field != "", field).otherwise("信息"))
    return F.concat(F.lit("["), depth, F.lit(" "), time_key, F.lit("] "), label, F.lit("："), information)


def render_turn_line(depth: Column, time_key: Column, role: Column, hhmm: Column, information: Column) -> Column:
    meta = F.concat_ws(" ", F.when(hhmm != "", hhmm), F.when(role != "", role))
    return F.concat(F.lit("["), depth, F.lit(" "), time_key, F.lit(" "),
                    F.when(meta == "", "excerpt").otherwise(meta), F.lit("] "), information)


def render_exact_line(role: Column, hhmm: Column, content: Column) -> Column:
    who = F.when(F.coalesce(role, F.lit("")) == "", "unknown").otherwise(role)
    return F.concat(F.lit("["), F.concat_ws(" ", who, F.when(hhmm != "", hhmm)), F.lit("] "), content)


def render_topic(name: Column, detail: Column) -> Column:
    return F.concat_ws(": ", F.when(name != "", name), F.when(detail != "", detail))


def render_key_item(kind: Column, desc: Column) -> Column:
    return (F.when((kind != "") & (desc != ""), F.concat(F.lit("["), kind, F.lit("] "), desc))
             .otherwise(F.concat(F.coalesce(desc, F.lit("")), F.coalesce(kind, F.lit("")))))
