"""Parsing of answers and captions as Column expressions over a text."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions.columns import strip


def split_sentences(text: Column) -> Column:
    """Sentences: cut after . ! ? where white space follows, trimmed, empty ones left out."""
    # Trimmed by a set of characters, those of \s: a regular expression would look at every character of every sentence.
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.btrim(s, F.lit(" \t\n\x0b\f\r"))), lambda s: s != "")


def tag_support(sentence: Column, vocabulary: dict[str, list[str]], available: dict[str, Column]) -> Column:
    """Sorted modalities whose keywords occur in the sentence and that the object has."""
    low = F.lower(sentence)
    marks = [F.when(reduce(or_, [F.contains(low, F.lit(w)) for w in words], F.lit(False)) & available[m], m) for m, words in sorted(vocabulary.items())]
    return F.array_compact(F.array(*marks))


def predict_label(text: Column, synonyms: dict[str, list[str]]) -> Column:
    """First label in vocabulary order whose name or a synonym is part of the text, ignoring case."""
    low = F.lower(text)
    hits = [F.when(F.exists(F.array(*[F.lit(w.lower()) for w in [label, *words]]), lambda w: F.contains(low, w)), label) for label, words in synonyms.items()]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def predict_code(text: Column, codes: dict[str, str]) -> Column:
    """Label of the first digit that has no digit beside it."""
    digit = F.regexp_extract(text, r"(?<!\d)([0-9])(?!\d)", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), digit)


def _last_end(text: Column, word: str) -> Column:
    """Where the last word-bounded occurrence ends; 0 without one."""
    pattern = rf"(?is)^.*(?<![\p{{L}}\p{{N}}_]){re.escape(word)}(?![\p{{L}}\p{{N}}_])"
    return F.length(F.regexp_extract(text, pattern, 0))


def last_mention(text: Column, synonyms: dict[str, list[str]]) -> Column:
    """Label mentioned last; at one end the longer mention, then the earlier label, counts."""
    found = []
    for k, (label, words) in enumerate(synonyms.items()):
        for word in [label, *words]:
            found.append(F.struct(_last_end(text, word).alias("end"), F.lit(len(word)).alias("size"), F.lit(-k).alias("order"), F.lit(label).alias("label")))
    best = F.array_max(F.array(*found))
    return F.when(best["end"] > 0, best["label"])


def predict_free_text(text: Column, synonyms: dict[str, list[str]]) -> Column:
    """Last mention in what follows the first FINAL ANSWER on its line, if it has one, else in the whole text."""
    final = F.regexp_extract(text, r"(?i)FINAL ANSWER\s*:\s*([^\n]+)", 1)
    return F.coalesce(F.when(final != "", last_mention(final, synonyms)), last_mention(text, synonyms))


def make_predictor(answer_format: str, synonyms: dict[str, list[str]], codes: dict[str, str] | None = None):
    """Expression of (text, stored label) for an answer format.

    ``digit_code`` looks for a code (and needs them), ``verbose_class`` for what is said last, ``logprob_argmax`` takes
    the stored label; ``free_text`` and any other format give the first label of the vocabulary that the text holds.
    """
    if answer_format == "digit_code":
        if codes is None:
            raise ValueError("digit_code needs the codes of the labels")
        return lambda text, stored: predict_code(text, codes)
    if answer_format == "verbose_class":
        return lambda text, stored: predict_free_text(text, synonyms)
    if answer_format == "logprob_argmax":
        return lambda text, stored: stored
    return lambda text, stored: predict_label(text, synonyms)


def argmax_label(logprobs: Column) -> Column:
    """Trimmed label of the greatest log-probability in a map; at a tie the greatest label."""
    entries = F.transform(F.map_entries(logprobs), lambda e: F.struct(e["value"].alias("value"), e["key"].alias("key")))
    return strip(F.array_max(entries)["key"])


def margin(values: Column) -> Column:
    """Best minus second of an array of log-probabilities; null with fewer than two."""
    ranked = F.sort_array(values, asc=False)
    return F.when(F.size(values) > 1, F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1)))


def parse_final_sentence(text: Column, labels: list[str]) -> Column:
    """Label in the last non-empty sentence or line, if all labels together occur exactly once there."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), strip), lambda s: s != "")
    last = F.try_element_at(parts, F.lit(-1))
    counts = [F.regexp_count(last, F.lit(rf"(?i)(?<![\p{{L}}\p{{N}}_]){re.escape(w)}(?![\p{{L}}\p{{N}}_])")) for w in labels]
    total = sum(counts[1:], counts[0])
    return F.when(total == 1, F.coalesce(*[F.when(c == 1, w) for c, w in zip(counts, labels, strict=True)]))


#: Fixed values of a final choice: what announces it, words and marks that may stand before the letter, and marks behind it.
FINAL, CHOICE_WORDS, OPENING, CLOSING = "FINAL ANSWER:", ("option", "choice"), "*([", "*)].:"


def _one_of(marks: str) -> str:
    return "[" + "".join("\\" + m for m in marks) + "]*"


#: The announcement, a word, opening marks, one letter, closing marks, then a blank or the end.
CHOICE = rf"(?i){FINAL}\s*(?:(?:{'|'.join(CHOICE_WORDS)})\s*)?{_one_of(OPENING)}([A-Z]){_one_of(CLOSING)}(?:\s|$)"
#: A letter that is a word of its own: no letter, digit or underscore beside it.
LONE_LETTER = r"(?U)\b([A-Za-z])\b"


def parse_single_choice(text: Column, letters: str) -> Column:
    """Last allowed letter that is announced as the final choice; only closing marks and white space may follow it."""
    found = F.transform(F.regexp_extract_all(text, F.lit(CHOICE), F.lit(1)), F.upper)
    return F.try_element_at(F.filter(found, lambda x: x.isin(*letters.upper())), F.lit(-1))


def parse_multi_choice(text: Column, letters: str) -> Column:
    """Allowed lone letters of the last FINAL ANSWER line in order, equal ones once; empty for NONE; null without a line."""
    line = F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?i){FINAL}\s*([^\n]*)"), F.lit(1)), F.lit(-1))
    found = F.transform(F.regexp_extract_all(line, F.lit(LONE_LETTER), F.lit(1)), F.upper)
    return F.when(line.isNotNull(), F.array_distinct(F.filter(found, lambda x: x.isin(*letters.upper()))))


def _says(text: Column, word: str) -> Column:
    """Whether a word or phrase stands in the text with word bounds around it, ignoring case."""
    return text.rlike(rf"(?iuU)\b{re.escape(word)}\b")


def parse_task_answer(text: Column, letters: dict[str, str], classes: dict[str, str] | None = None) -> Column:
    """Label of the chosen letter, else the first category that the text names, else that of the first class key it names.

    Categories are taken in the order of their letters, class keys in the order of ``classes`` (key to category).
    """
    by_letter = F.create_map(*[F.lit(x) for kv in letters.items() for x in kv])
    chosen = F.try_element_at(by_letter, parse_single_choice(text, "".join(letters)))
    named = [F.when(_says(text, word), label) for word, label in [*[(v, v) for v in letters.values()], *(classes or {}).items()]]
    return F.coalesce(chosen, *named)


def parse_lines_answer(text: Column, letters: dict[str, str], candidates: Column | None = None) -> Column:
    """Names of the chosen letters, sorted, candidates only; null without an answer."""
    by_letter = F.create_map(*[F.lit(x) for kv in letters.items() for x in kv])
    names = F.transform(parse_multi_choice(text, "".join(letters)), lambda x: F.try_element_at(by_letter, x))
    return F.array_sort(names if candidates is None else F.array_intersect(names, candidates))


def ground_truth_class(name: Column, aliases: dict[str, str], categories: dict[str, str]) -> Column:
    """Class by exact alias, then ignoring case, then by category; UNKNOWN otherwise."""
    exact = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    folded = F.create_map(*[F.lit(x) for k, v in {k.lower(): v for k, v in aliases.items()}.items() for x in (k, v)])
    category = F.create_map(*[F.lit(x) for k, v in categories.items() for x in (k.lower(), v)])
    low = F.lower(strip(name))
    return F.coalesce(F.try_element_at(exact, name), F.try_element_at(folded, low), F.try_element_at(category, low), F.lit("UNKNOWN"))


def ground_truth_lines(detected: Column, snr_of: Column) -> Column:
    """Map of each detected line to its signal-to-noise ratio, 1.0 where ``snr_of`` (a map) has none; null without a list."""
    return F.map_from_entries(F.transform(F.array_distinct(detected), lambda x: F.struct(x, F.coalesce(F.try_element_at(snr_of, x), F.lit(1.0)))))


def truth_labels(lines: Column) -> Column:
    """Lines of a ground-truth map, sorted; ``regime`` isn't one. Null counts as none."""
    return F.coalesce(F.array_sort(F.filter(F.map_keys(lines), lambda x: x != "regime")), F.array().cast("array<string>"))


def has_caption(raw: Column) -> Column:
    return F.coalesce(raw.rlike(r"(?i)CAPTION:"), F.lit(False))


def extract_caption(raw: Column) -> Column:
    """Text after the last CAPTION: marker, without quotes around it."""
    return strip(F.regexp_replace(strip(F.regexp_replace(raw, r"(?is)^.*CAPTION:", "")), "^[\"']+|[\"']+$", ""))


def human_subset(subset: Column, names: dict[str, str]) -> Column:
    """Readable modality names joined by " and "."""
    readable = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.array_join(F.transform(subset, lambda m: F.coalesce(F.try_element_at(readable, m), m)), " and ")


def wrapper_text(subset: Column, names: dict[str, str], before: str, after: str) -> Column:
    """Text around an observation; ``{modalities}`` is filled."""
    return F.concat(F.replace(F.lit(before), F.lit("{modalities}"), human_subset(subset, names)), F.lit(after))


def caption_target(caption: Column, suffix: str, longest: int) -> Column:
    """Caption cut so that it and the suffix have ``longest`` white-space tokens; an empty one stays empty."""
    room = max(0, longest - len(suffix.split()))
    words = F.filter(F.split(caption, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) == 0, "").otherwise(F.concat(F.array_join(F.slice(words, 1, room), " "), F.lit(f" {suffix}" if suffix else "")))


def fill_template(template: str, **values: Column) -> Column:
    """Template with {name} replaced by columns; null values become empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def numbered(items: Column) -> Column:
    """1. first, 2. second, ... one a line."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def lettered(items: Column) -> Column:
    """A) first, B) second, ... one a line."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.chr(i + 65), F.lit(") "), x)), "\n")


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def is_correct(predicted: Column, truth: Column, many: bool = False) -> Column:
    """Set equality for lists; else equality without case and outer space; null is wrong."""
    same = F.array_sort(predicted) == F.array_sort(truth) if many else F.lower(strip(predicted)) == F.lower(strip(truth))
    return F.coalesce(same, F.lit(False))


def decompose_claims(df: DataFrame, key: str, text: str, source: str, vocabulary: dict[str, list[str]], available: dict[str, Column]) -> DataFrame:
    """(key, claim_pos, text, supporting, kind, provenance): sentences with support; more than one modality makes a relation."""
    each = df.select("*", F.posexplode(split_sentences(F.col(text))).alias("claim_pos", "_sentence"))
    tagged = each.withColumn("supporting", tag_support(F.col("_sentence"), vocabulary, available)).where("size(supporting) > 0")
    kind = F.when(F.size("supporting") > 1, "relation").otherwise("observation")
    return tagged.select(key, "claim_pos", F.col("_sentence").alias("text"), "supporting", kind.alias("kind"), F.concat(F.col(source), F.lit("#sent"), F.col("claim_pos").cast("string")).alias("provenance"))
