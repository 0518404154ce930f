"""Repair and validation of JSON documents that a model wrote, on VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from memlake.functions import let
from memlake.functions.text import strip

# --- fixed values: the document contracts -----------------------------------------
KEY_ITEM_TYPES = ("milestone", "bug_fix", "config_change", "decision", "incident", "question")
MEMORY_SIGNALS = ("low", "normal")
DAY_KEYS = ("memory_signal", "topics", "decisions", "todos", "summary", "key_items", "tags", "day_mood",
            "emotional_peaks", "source_turns")
WEEK_KEYS = ("week", "window_date_start", "window_date_end", "week_mood", "summary", "tags", "topics",
             "decisions", "todos", "key_items", "emotional_peaks")
WINDOW_KEYS = ("window", "window_date_start", "window_date_end", "source_weeks", "window_mood", "summary",
               "tags", "topics", "decisions", "todos", "key_items", "emotional_peaks")
# ----------------------------------------------------------------------------------


def parse_strict(text: Column) -> Column:
    """A JSON text as a VARIANT, null unless all of it is one value.

    The parser stops after the first value. Inside brackets what follows must
    make a second element or break; inside an object a closing bracket breaks.
    """
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    alone = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()
    return let(items, lambda found: F.when((F.size(found) == 1) & alone, F.element_at(found, 1)))


def repair_json(text: Column) -> Column:
    """Struct `(method, document)`: the first reading of the text that parses.

    Readings: as it is; inside a code fence; from the first `{` to the last `}`.
    Text after the object, such as stray brackets, falls away with the third.
    Both fields are null when nothing parses.
    """
    def reading(method: str, candidate: Column) -> Column:
        return let(parse_strict(candidate), lambda document: F.when(
            document.isNotNull(), F.struct(F.lit(method).alias("method"), document.alias("document"))))

    def unfenced(bare: Column) -> Column:
        inner = F.regexp_extract(bare, r"(?s)\A```[^\n]*\n(.*?)(?:(?<=\n)[ \t]*```)\z", 1)
        return F.when(inner == "", bare).otherwise(strip(inner))

    def readings(bare: Column) -> Column:
        return let(unfenced(bare), lambda fenced: F.coalesce(
            reading("direct", bare),
            reading("strip_markdown_fence", F.when(fenced != bare, fenced)),
            reading("extract_outer_json_object", F.nullif(F.regexp_extract(fenced, r"(?s)(\{.*\})", 1), F.lit("")))))

    return let(strip(text), readings)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _field(document: Column, name: str) -> Column:
    return F.try_variant_get(document, f"$.{name}", "variant")


def _keys_are(document: Column, keys: tuple[str, ...]) -> Column:
    present = F.map_keys(F.try_variant_get(document, "$", "map<string,variant>"))
    return F.coalesce(F.sort_array(present) == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))


def _is_text(value: Column) -> Column:
    return F.coalesce(_kind(value) == "STRING", F.lit(False))


def _is_whole(value: Column) -> Column:
    return F.coalesce(_kind(value) == "BIGINT", F.lit(False))


def _all_items(value: Column, test) -> Column:
    return F.coalesce(F.forall(F.try_variant_get(value, "$", "array<variant>"), test), F.lit(False))


def _topics(value: Column) -> Column:
    return _all_items(value, lambda t: _keys_are(t, ("name", "detail"))
                      & _is_text(_field(t, "name")) & _is_text(_field(t, "detail")))


def _key_items(value: Column) -> Column:
    return _all_items(value, lambda k: _keys_are(k, ("type", "desc")) & _is_text(_field(k, "desc"))
                      & _is_text(_field(k, "type"))
                      & F.coalesce(F.try_variant_get(k, "$.type", "string").isin(*KEY_ITEM_TYPES), F.lit(False)))


def _peaks(value: Column, anchor: str, anchor_test, bounded: bool) -> Column:
    def test(peak: Column) -> Column:
        ok = (_keys_are(peak, (anchor, "emotion", "intensity", "context"))
              & anchor_test(_field(peak, anchor)) & _is_text(_field(peak, "emotion"))
              & _is_text(_field(peak, "context")) & _is_whole(_field(peak, "intensity")))
        if bounded:
            ok = ok & F.coalesce(F.try_variant_get(peak, "$.intensity", "bigint").between(1, 5), F.lit(False))
        return ok

    return _all_items(value, test)


def _first_failure(checks: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks])


def day_summary_problem(document: Column) -> Column:
    """Name of the first rule a day summary breaks, null when it is valid."""
    def get(name: str) -> Column:
        return _field(document, name)

    return _first_failure([
        ("keys", _keys_are(document, DAY_KEYS)),
        ("memory_signal", _is_text(get("memory_signal"))
         & F.try_variant_get(document, "$.memory_signal", "string").isin(*MEMORY_SIGNALS)),
        ("topics", _topics(get("topics"))),
        ("decisions", _all_items(get("decisions"), _is_text)),
        ("todos", _all_items(get("todos"), _is_text)),
        ("summary", _is_text(get("summary"))),
        ("key_items", _key_items(get("key_items"))),
        ("tags", _all_items(get("tags"), _is_text)),
        ("day_mood", _is_text(get("day_mood"))),
        ("emotional_peaks", _peaks(get("emotional_peaks"), "turn", _is_whole, bounded=True)),
        ("source_turns", _all_items(get("source_turns"), _is_whole)),
    ])


def _rollup_problem(document: Column, keys: tuple[str, ...], texts: tuple[str, ...], weeks: bool) -> Column:
    def get(name: str) -> Column:
        return _field(document, name)

    checks = [("keys", _keys_are(document, keys))]
    checks += [(name, _is_text(get(name))) for name in texts]
    lists = (("source_weeks",) if weeks else ()) + ("tags", "decisions", "todos")
    checks += [(name, _all_items(get(name), _is_text)) for name in lists]
    checks += [("topics", _topics(get("topics"))), ("key_items", _key_items(get("key_items"))),
               # unlike day summaries, rollups do not limit the intensity
               ("emotional_peaks", _peaks(get("emotional_peaks"), "date", _is_text, bounded=False))]
    return _first_failure(checks)


def week_summary_problem(document: Column) -> Column:
    return _rollup_problem(document, WEEK_KEYS,
                           ("week", "window_date_start", "window_date_end", "week_mood", "summary"), False)


def window_summary_problem(document: Column) -> Column:
    return _rollup_problem(document, WINDOW_KEYS,
                           ("window", "window_date_start", "window_date_end", "window_mood", "summary"), True)
