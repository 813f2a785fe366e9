"""Text columns: cleaning, rendering, instructions and keys.  A null text is read as empty."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def ranges(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Where to cut a batch of texts into parts of `most` bytes, or of one text."""
    upto, at = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + most, "right")) - 1)
        yield at, end
        at = end


def filled(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rstrip_lines(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda line: F.regexp_replace(line, r"(?U)\s+$", "")), "\n")


def squeeze(text: Column) -> Column:
    """At most one blank line in a row, and one space for spaces and tabs."""
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]+", " ")


def cleanup_whitespace(text: Column) -> Column:
    return strip(rstrip_lines(squeeze(filled(text))))


def cleanup_punctuation(text: Column) -> Column:
    """Repeated exclamation and question marks once, four or more dots as three."""
    out = F.regexp_replace(filled(text), "!{2,}", "!")
    return F.regexp_replace(F.regexp_replace(out, r"\?{2,}", "?"), r"\.{4,}", "...")


def normalize_prompt(text: Column) -> Column:
    """Line ends as LF, blanks squeezed, and a line that equals the one before it dropped."""
    unix = F.regexp_replace(strip(filled(text)), "\r\n|\r", "\n")
    spaced = F.regexp_replace(F.regexp_replace(unix, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    lines = F.transform(F.split(spaced, "\n", -1), lambda line: F.regexp_replace(line, r"(?U)\s+$", ""))

    def kept(all_: Column) -> Column:
        # each line beside the one before it; the first beside null
        pairs = F.arrays_zip(all_.alias("line"), F.concat(F.array(F.lit(None).cast("string")), F.slice(all_, 1, F.size(all_) - 1)).alias("before"))
        return F.array_join(F.transform(F.filter(pairs, lambda p: p["before"].isNull() | (p["line"] != p["before"])), lambda p: p["line"]), "\n")

    # a lambda's variable is computed once, a plain column once for every line
    return F.get(F.transform(F.array(lines), kept), 0)


def word_list(text: Column) -> Column:
    """Runs of a-z, 0-9 and apostrophes in the lower-cased text."""
    return F.regexp_extract_all(F.lower(filled(text)), F.lit("[a-z0-9']+"), F.lit(0))


def word_set(text: Column) -> Column:
    return F.array_distinct(word_list(text))


def output_instruction(mode: Column) -> Column:
    """The instruction of an output mode; none without a mode.  The texts are fixed values."""
    m = F.lower(mode)
    return (
        F.when(mode.isNull() | (mode == ""), F.lit(None).cast("string"))
        .when(m == "bullets", "Respond with concise bullet points. Keep it under 6!")
        .when(m == "short", "Respond in short sentences. Be concise!")
        .when(m == "code", "Return code only in a single block, no prose.")
        .otherwise("Be Concise!")
    )


def digest_key(*parts: Column) -> Column:
    """sha-256 of the parts joined by two bars; a null part is empty."""
    return F.sha2(F.concat_ws("||", *[filled(p) for p in parts]), 256)


def prefix_key(system: Column, model: Column) -> Column:
    return F.concat(F.lit("cache:prefix:"), filled(model), F.lit(":"), F.sha2(filled(system), 256))


def turn_key(system: Column, history: Column, query: Column, model: Column) -> Column:
    """Key of a whole request; `history` is an array of texts."""
    texts = F.concat(F.array(filled(system)), F.transform(history, lambda t: F.coalesce(t, F.lit(""))), F.array(filled(query)))
    return F.concat(F.lit("cache:turn:"), filled(model), F.lit(":"), F.sha2(F.array_join(texts, "||"), 256))


#: What a user says when the context was lost, with the confidence of each tier.  Fixed values.
LOSS_PHRASES = (
    (("i already told you", "as i mentioned", "you forgot", "remember when i said"), 0.95),
    (("as i said", "like i said", "i told you earlier", "you didn't remember"), 0.8),
    (("you missed that", "you lost track", "you keep forgetting"), 0.7),
)


def context_loss(text: Column) -> Column:
    """detected, phrase and confidence of the first tier that occurs."""
    found = [(F.regexp_extract(filled(text), rf"(?i)\b({'|'.join(phrases)})\b", 1), confidence) for phrases, confidence in LOSS_PHRASES]
    phrase, sure = F.lit(""), F.lit(0.0)
    for hit, confidence in reversed(found):
        phrase, sure = F.when(hit != "", hit).otherwise(phrase), F.when(hit != "", F.lit(confidence)).otherwise(sure)
    return F.struct((phrase != "").alias("detected"), phrase.alias("phrase"), sure.alias("confidence"))


def rendered_context(system: Column, summary: Column, turns: Column) -> Column:
    """[System], [Summary] and [role] lines; `turns` is an ordered array of structs with role and content."""
    head = F.array(F.when(filled(system) != "", F.concat(F.lit("[System]\n"), system)), F.when(filled(summary) != "", F.concat(F.lit("[Summary]\n"), summary)))
    lines = F.transform(turns, lambda t: F.concat(F.lit("["), F.coalesce(t["role"], F.lit("user")), F.lit("] "), F.coalesce(t["content"], F.lit(""))))
    return strip(F.array_join(F.filter(F.concat(head, lines), lambda x: x.isNotNull()), "\n"))


def rendered_chat(summary: Column, turns: Column, recent: Column | int) -> Column:
    """The chat endpoint's context: a summary line and the last `recent` turns."""
    n = F.lit(recent) if isinstance(recent, int) else recent
    last = F.slice(turns, F.greatest(F.lit(1), F.size(turns) - n + 1), F.greatest(n, F.lit(0)))
    lines = F.transform(last, lambda t: F.concat(F.initcap(F.coalesce(t["role"], F.lit("user"))), F.lit(": "), F.coalesce(t["content"], F.lit(""))))
    head = F.when(filled(summary) != "", F.array(F.concat(F.lit("Summary: "), summary))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, F.when(F.size(lines) > 0, F.concat(F.array(F.lit("Recent:")), lines)).otherwise(F.array().cast("array<string>"))), "\n")
