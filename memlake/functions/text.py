"""Cleaning, redaction, tokenising and token estimates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from memlake.functions import let

# --- fixed values: whitespace trimmed at text ends ------------------------------
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
              "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# --- fixed values: separators that end a match token ----------------------------
SEPARATORS = "\n\t,，.。!！?？:：;；()（）[]【】/\\|\"'-_"
BLANKS = "".join(dict.fromkeys(SEPARATORS + WHITESPACE))  # what ends a token
# --- fixed values: what is redacted, in this order -------------------------------
REDACTED = "[REDACTED]"
REDACT_PATTERNS = {
    "key": r"(?iU)(sk-|pk-|api[-_]?key[\s=:]+)\S{10,}",
    "mobile": r"(?U)\b1[3-9]\d{9}\b",
    "email": r"(?U)\b[\w.+-]+@[\w.-]+\.\w{2,}\b",
    "digits": r"(?U)\b\d{9,10}\b",
    "ipv4": r"(?U)\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}
# A text without any of these cannot match a pattern above; one cheap scan spares five.
REDACT_GUARD = r"(?iu)sk-|pk-|api|@|\p{Nd}{9}|\p{Nd}\.\p{Nd}"
# --- fixed values: markers of audio messages -------------------------------------
AUDIO_MARKERS = ("[Audio]", "User text:", "Transcript:", "[Telegram ")
# ----------------------------------------------------------------------------------

_LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def redact(text: Column) -> Column:
    cleaned = text
    for pattern in REDACT_PATTERNS.values():
        cleaned = F.regexp_replace(cleaned, pattern, F.lit(REDACTED))
    return F.when(text.rlike(REDACT_GUARD), cleaned).otherwise(text)


def redaction_hits(text: Column) -> dict[str, Column]:
    """Matches per pattern, each counted on the text the earlier patterns left."""
    hits, remaining = {}, text
    guard = text.rlike(REDACT_GUARD)
    for name, pattern in REDACT_PATTERNS.items():
        hits[name] = F.when(guard, F.regexp_count(remaining, F.lit(pattern))).otherwise(F.lit(0))
        remaining = F.regexp_replace(remaining, pattern, F.lit(REDACTED))
    return hits


def strip_metadata_envelope(text: Column) -> Column:
    """Remove the two JSON header blocks a host puts before user text; keep the text if nothing is left."""
    block = r"\(untrusted metadata\):\s*```json\s*.*?```\s*"
    bare = strip(F.regexp_replace(text, rf"(?sU)\AConversation info {block}Sender {block}", ""))
    return F.when(text.startswith("Conversation info (untrusted metadata):"),
                  let(bare, lambda b: F.when(b == "", text).otherwise(b))).otherwise(text)


def strip_reply_tags(text: Column) -> Column:
    tagged = r"(?mdU)^(?:(?:\[\[reply_to_current\]\]|\[\[reply_to:[^\]]+\]\])\s*)+"
    left = F.ltrim(text, F.lit(WHITESPACE))
    return F.ltrim(F.regexp_replace(left, tagged, ""), F.lit(WHITESPACE))


def message_type(text: Column, role: Column) -> Column:
    is_audio = role == "user"
    for marker in AUDIO_MARKERS:
        is_audio = is_audio & text.contains(marker)
    return F.when(is_audio, "audio").otherwise("text")


def audio_transcript_text(text: Column) -> Column:
    """The spoken text of an audio message: the user part if there is one, else the transcript."""
    def after(value: Column, marker: str) -> Column:
        return F.substr(value, F.instr(value, marker) + F.lit(len(marker)))

    def without_sender(line: Column) -> Column:
        return F.when(line.startswith("[Telegram ") & line.contains("]"), strip(after(line, "]"))).otherwise(line)

    def unwrap(lines: Column) -> Column:
        return F.array_join(F.filter(F.transform(
            lines, lambda line, i: F.when(i == 0, without_sender(line)).otherwise(line)), lambda line: line != ""), "\n")

    user_part = strip(F.substring_index(after(text, "User text:"), "Transcript:", 1))
    spoken = let(F.filter(F.transform(F.split(user_part, _LINE_BREAK), strip), lambda line: line != ""), unwrap)
    heard = F.when(text.contains("Transcript:"), _nonblank(strip(after(text, "Transcript:"))))
    both = F.when(text.contains("User text:") & text.contains("Transcript:"), _nonblank(spoken))
    return F.when(text.contains("[Audio]"), F.coalesce(both, heard, text)).otherwise(text)


def clean_user_text(text: Column) -> Column:
    """Struct of cleaned `text` and `message_type` for one user text."""
    def cleaned(bare: Column) -> Column:
        kind = message_type(bare, F.lit("user"))
        spoken = F.when(kind == "audio", audio_transcript_text(bare)).otherwise(bare)
        return F.struct(let(spoken, redact).alias("text"), kind.alias("message_type"))

    return let(let(text, strip_metadata_envelope), lambda t: let(strip_reply_tags(t), cleaned))


def join_text_blocks(blocks: Column, role: Column) -> Column:
    """Clean the text blocks of one message and join them.

    `blocks` is an array of structs with `type` and `text`. Other block kinds
    are dropped. The message type is that of the last non-blank text block.
    """
    texts = F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: strip(b["text"])),
                     lambda t: t != "")
    cleaned = F.transform(texts, lambda t: F.when(
        role == "assistant",
        F.struct(strip_reply_tags(t).alias("text"), F.lit("text").alias("message_type"))
    ).otherwise(clean_user_text(t)))
    return let(cleaned, lambda parts: F.struct(
        let(F.array_join(F.filter(F.transform(parts, lambda c: c["text"]), lambda t: t != ""), " "), redact).alias("content"),
        F.coalesce(F.try_element_at(parts, F.lit(-1))["message_type"], F.lit("text")).alias("message_type")))


# --- tokens --------------------------------------------------------------------

def estimate_tokens(length: Column, chars_per_token: int) -> Column:
    """Tokens of a text of `length` characters."""
    if chars_per_token <= 0:
        raise ValueError("chars_per_token must be positive")
    return F.when(length > 0, F.greatest(F.lit(1), F.floor(length / chars_per_token))).otherwise(
        F.lit(0)).cast("bigint")


def spaced(text: Column) -> Column:
    """Lower-cased text with every separator and blank turned into a plain space."""
    return F.translate(F.lower(text), BLANKS, " " * len(BLANKS))


def match_tokens(text: Column) -> Column:
    """Match tokens in text order, repeats kept."""
    return F.array_remove(F.split(spaced(text), " "), F.lit(""))


def dedupe_text(text: Column) -> Column:
    """Text reduced to lower-case words, for near-verbatim comparison."""
    return F.btrim(F.regexp_replace(F.lower(text), r"(?U)[\W_]+", " "))


def middle_trim(text: Column, length: Column) -> Column:
    """Keep the ends of a text: 60 % head, 40 % tail, dots between."""
    usable = length - 3
    head = F.floor(usable * 0.6).cast("int")
    return (F.when(F.length(text) <= length, text)
             .when(length <= 8, F.left(text, length))
             .otherwise(F.concat(F.left(text, head), F.lit("..."), F.right(text, usable - head))))


def _nonblank(value: Column) -> Column:
    return F.when(value != "", value)


def flatten_entry_text(entry: dict[str, Column]) -> Column:
    """One searchable string over the nested fields of an index entry.

    Keys that may be given: summary, mood, day_mood (strings); tags, decisions,
    todos (string arrays); topics, key_items, emotional_peaks (struct arrays).
    """
    parts = []
    for name in ("summary", "tags", "mood", "day_mood", "topics", "decisions", "todos", "key_items",
                 "emotional_peaks"):
        if name not in entry:
            continue
        value = entry[name]
        if name in ("tags", "decisions", "todos"):
            value = F.array_join(value, " ")
        elif name == "topics":
            value = F.array_join(F.transform(value, lambda t: F.concat_ws(
                " ", F.lit("name"), t["name"], F.lit("detail"), t["detail"])), " ")
        elif name == "key_items":
            value = F.array_join(F.transform(value, lambda k: F.concat_ws(
                " ", F.lit("type"), k["type"], F.lit("desc"), k["desc"])), " ")
        elif name == "emotional_peaks":
            value = F.array_join(F.transform(value, lambda p: F.concat_ws(
                " ", F.lit("turn"), p["turn"].cast("string"), F.lit("emotion"), p["emotion"],
                F.lit("intensity"), p["intensity"].cast("string"), F.lit("context"), p["context"])), " ")
        parts.append(_nonblank(value))
    return strip(F.concat_ws(" ", *parts))


def embed_text(summary: Column, tags: Column, mood: Column) -> Column:
    """The labelled text that is turned into a vector. Labels are fixed values."""
    return F.concat_ws(
        "\n",
        F.when(strip(summary) != "", F.concat(F.lit("摘要："), strip(summary))),
        F.when(F.size(tags) > 0, F.concat(F.lit("标签："), F.array_join(tags, ", "))),
        F.when(strip(mood) != "", F.concat(F.lit("情绪："), strip(mood))))
