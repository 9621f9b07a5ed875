"""Text functions as columns; Arrow-batched Python only where a scan keeps state."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as an identifier in free text, in order of precedence.
IDENTIFIER_FORMS = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"\b[0-9a-f]{7,40}\b",
    r"\b[\w.-]+/[\w./-]+\b",
    r"\b\d+\.\d+\.\d+[\w.-]*\b",
    r"\b[A-Za-z_][\w.-]*[0-9_][\w.-]*\b",
    r"\b[A-Za-z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b",
    r"\b[a-zA-Z_][\w]*(?:\.[a-zA-Z_][\w]*)+\b",
)
MAX_IDENTIFIERS = 8

# Personal data, masked in this order.
PII_FORMS = (
    ("card", r"(?<![\d-])(?:\d{4}[ -]?){3}\d{4}(?![\d-])"),
    ("phone", r"(?<!\d)(?:\+7|8)[ (-]*\d{3}[ )-]*\d{3}[ -]?\d{2}[ -]?\d{2}(?!\d)"),
    ("snils", r"(?<![\d-])\d{3}-\d{3}-\d{3}[ -]\d{2}(?![\d-])"),
    ("passport_rf", r"(?<!\d)\d{2} ?\d{2} \d{6}(?!\d)"),
    ("inn", r"(?<=\bИНН)\W{0,3}\d{10}(?:\d{2})?(?!\d)"),
    ("email", r"[\w.+-]+@[\w-]+\.[\w.-]+"),
)

# Phrases by which a text tries to give instructions to a model.
INJECTION_FORMS = (
    r"ignore\s+(all\s+|the\s+)?(previous|prior|above|preceding|earlier)\s+(instructions?|prompts?|context|messages?)",
    r"disregard\s+(all\s+|the\s+)?(previous|prior|above|preceding|earlier)\s+\w+",
    r"forget\s+(everything|all|(the\s+)?(previous|above)\s+\w+)",
    r"(you\s+are\s+now|from\s+now\s+on\s+you|act\s+as|pretend\s+to\s+be)\b",
    r"new\s+(instructions?|rules?|task)\s*:",
    r"(system|developer)\s+prompt\b",
    r"<\s*/?\s*(system|assistant|user|developer|im_start|im_end)\s*>",
    r"^\s*(system|assistant|user|developer)\s*:",
    r"игнорир\w*\s+(все\s+|вс[ея]\s+)?(предыдущ\w+|вышеуказанн\w+|ранее\s+данн\w+)\s+(инструкц\w+|указани\w+|контекст\w*)",
    r"забуд\w+\s+(все\s+|вс[ея]\s+)?(предыдущ\w+\s+)?(инструкц\w+|указани\w+|правил\w+)",
    r"(ты\s+теперь|отныне\s+ты|представь[,\s]+что\s+ты|веди\s+себя\s+как)\b",
    r"нов\w+\s+(инструкц\w+|правил\w+|задани\w+)\s*:",
    r"систем\w+\s+промпт\w*",
)
NEUTRALIZED = "⟦инструкция нейтрализована⟧"
INVISIBLE = r"[​-‏‪-‮⁠-⁤⁦-⁩﻿]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
CHUNK_MAX, CHUNK_MIN = 1200, 200


def distinct_by(array: Column, key) -> Column:
    """Elements of an array whose key no earlier element has, in order."""
    return F.filter(array, lambda x, i: F.array_position(F.transform(array, key), key(x)) == i + 1)


def identifiers(text: Column, limit: int = MAX_IDENTIFIERS) -> Column:
    """Identifier-like tokens in order of appearance, each once regardless of case, at most `limit`."""
    found = F.regexp_extract_all(text, F.lit("(?U)(" + "|".join(IDENTIFIER_FORMS) + ")"), F.lit(1))
    usable = F.filter(found, lambda t: (F.length(t) >= 3) & ~t.rlike(r"^\d{1,4}$"))
    return F.slice(distinct_by(usable, F.lower), 1, limit)


def neutralize(text: Column) -> Column:
    """Invisible and control characters gone, instruction phrases replaced."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), INVISIBLE, ""), CONTROL, "")
    return reduce(lambda c, form: F.regexp_replace(c, f"(?iuU){form}", NEUTRALIZED), INJECTION_FORMS, clean)


def wrap_untrusted(text: Column, label: str) -> Column:
    """Neutralised text between marks that it cannot contain itself."""
    clean = F.replace(F.replace(neutralize(text), F.lit("<<"), F.lit("‹‹")), F.lit(">>"), F.lit("››"))
    return F.concat(F.lit(f"<<{label}>>\n"), clean, F.lit(f"\n<</{label}>>"))


def _mask_cards(text: Column) -> Column:
    """Card numbers that pass the checksum, masked one found form at a time."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(f"({PII_FORMS[0][1]})"), F.lit(1)), lambda m: F.call_function("luhn_check", F.regexp_replace(m, r"\D", ""))))
    return F.aggregate(found, text, lambda s, m: F.replace(s, m, F.lit("[ПДн:card]")))


def mask_pii(text: Column) -> Column:
    """Personal data replaced by [ПДн:kind], kind after kind, so that a mask hides its text from later kinds."""
    return reduce(lambda c, x: F.regexp_replace(c, f"(?U){x[1]}", f"[ПДн:{x[0]}]"), PII_FORMS[1:], _mask_cards(text))


def pii_counts(text: Column) -> dict[str, Column]:
    """How often each kind is found, on the text with valid cards taken out first."""
    cards = F.filter(F.regexp_extract_all(text, F.lit(f"({PII_FORMS[0][1]})"), F.lit(1)), lambda m: F.call_function("luhn_check", F.regexp_replace(m, r"\D", "")))
    counts, rest = {"card": F.size(cards).cast("long")}, _mask_cards(text)
    for kind, form in PII_FORMS[1:]:
        counts[kind] = F.regexp_count(rest, F.lit(f"(?U){form}")).cast("long")
        rest = F.regexp_replace(rest, f"(?U){form}", f"[ПДн:{kind}]")
    return counts


def normalize_placeholders(value: Column) -> Column:
    return F.regexp_replace(value, r"\{[^{}\s]*\}", "{}")


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility forms composed (NFKC) and case folded."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def label_norm(label: Column) -> Column:
    """Case-folded words in their compatibility forms with one space between."""
    return F.trim(F.regexp_replace(folded(label), r"(?U)[\W_]+", " "))


def shingles(text: Column, k: int = 3) -> Column:
    """Distinct character k-grams; a shorter text is its own."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (k - 1), F.lit(1))), lambda i: F.substr(text, i, F.lit(k)))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def entropy(label: Column) -> Column:
    """Shannon entropy of the characters of a label, in bits."""
    chars = F.filter(F.split(label, ""), lambda c: F.length(c) > 0)
    size = F.length(label).cast("double")
    each = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / size)
    return F.when(F.length(label) == 0, 0.0).otherwise(F.aggregate(each, F.lit(0.0), lambda s, p: s - p * F.log2(p)))


def sanitize_label(name: Column) -> Column:
    """A name of letters, digits and underscores that begins with no digit."""
    clean = F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9_]", "_")
    return F.when(clean == "", "entity").when(clean.rlike(r"^[0-9]"), F.concat(F.lit("t_"), clean)).otherwise(clean)


def is_sentence_like(label: Column) -> Column:
    return ((F.length(label) >= 80) | (F.size(F.split(F.trim(label), r"\s+")) >= 8)) & label.rlike(r"[.!?:;]")


def first_line(text: Column, limit: int = 120) -> Column:
    return F.substr(F.substring_index(F.trim(text), "\n", 1), F.lit(1), F.lit(limit))


def repair_scheme(key: Column) -> Column:
    """A scheme whose two slashes were folded into one gets both again."""
    return F.regexp_replace(key, r"^([A-Za-z][A-Za-z0-9+.-]*):/(?!/)", "$1://")


def wikilinks(text: Column) -> Column:
    """Links [[path#anchor|alias]] as structs, in order."""
    inner = F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))
    plain = F.transform(inner, lambda x: F.trim(F.replace(F.replace(x, F.lit("\\|"), F.lit("|")), F.lit("\\#"), F.lit("#"))))

    def parse(raw: Column) -> Column:
        target = F.trim(F.substring_index(raw, "|", 1))
        alias = F.when(F.instr(raw, "|") > 0, F.trim(F.substr(raw, F.instr(raw, "|") + 1)))
        anchor = F.when(F.instr(target, "#") > 0, F.trim(F.substr(target, F.instr(target, "#") + 1)))
        return F.struct(raw.alias("raw"), F.trim(F.substring_index(target, "#", 1)).alias("path"), anchor.alias("anchor"), F.nullif(alias, F.lit("")).alias("alias"))

    return F.transform(plain, parse)


def search_text(title: Column, fields: dict[str, Column]) -> Column:
    """Title and a line for each field that has a value."""
    lines = [title, *(F.when(F.length(c) > 0, F.concat(F.lit(f"{k}: "), c)) for k, c in fields.items())]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def entity_text(title: Column, kind: Column, key: Column, attributes: Column, most: int = 1000) -> Column:
    pairs = F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    tail = F.when(F.size(pairs) > 0, F.concat(F.lit("; "), F.array_join(pairs, ", "))).otherwise("")
    return F.substr(F.concat(title, F.lit(" ("), kind, F.lit(" "), key, F.lit(")"), tail), F.lit(1), F.lit(most))


def provenance_path(repo: Column, sha: Column, path: Column, line: Column) -> Column:
    """repo@sha:path:line from the parts that are there."""
    head = F.concat(F.coalesce(repo, F.lit("")), F.when(sha.isNotNull(), F.concat(F.lit("@"), sha)).otherwise(""))
    tail = F.concat(path, F.when(line.isNotNull(), F.concat(F.lit(":"), line.cast("string"))).otherwise(""))
    return F.concat_ws(":", F.nullif(head, F.lit("")), tail)


def compile_template(template: str) -> tuple[str, list[str]]:
    """Regular expression and names of a key template like svc:<name>/{path}; a name met again must match the same text."""
    names, out, at = [], "", 0
    for m in re.finditer(r"<([^<>\s]+)[^<>]*>|\{([^{}\s]+)\}", template):
        name = m[1] or m[2]
        out += re.escape(template[at : m.start()])
        out += f"\\{names.index(name) + 1}" if name in names else "(.+?)"
        names += [] if name in names else [name]
        at = m.end()
    return f"^{out}{re.escape(template[at:])}$", names


def split_key(key: Column, template: str) -> Column:
    """Map of placeholders to what they stand for in a key; null where the key does not fit."""
    form, names = compile_template(template)
    parts = [x for i, n in enumerate(names) for x in (F.lit(n), F.regexp_extract(key, form, i + 1))]
    return F.when(key.rlike(form), F.create_map(*parts) if parts else F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>")))


def render_key(template: str, values: dict[str, Column]) -> Column:
    """The key for given values; null where one is missing."""
    parts, at = [], 0
    for m in re.finditer(r"<([^<>\s]+)[^<>]*>|\{([^{}\s]+)\}", template):
        parts += [F.lit(template[at : m.start()]), values[m[1] or m[2]].cast("string")]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def _pieces(text: str, most: int, least: int) -> list[str]:
    """A section's text in pieces of whole paragraphs (of lines, where a paragraph is too long)."""
    if len(text) <= most:
        return [text]
    out, now = [], ""
    for block in (b.strip() for b in re.split(r"\n\s*\n", text)):
        if not block:
            continue
        units, glue = (block.split("\n"), "\n") if len(block) > most else ([block], "\n\n")
        for unit in units:
            if now and len(now) + len(unit) + len(glue) > most:
                out, now = [*out, now.strip()], ""
            now += unit + glue
    if now.strip():
        out.append(now.strip())
    if len(out) > 1 and len(out[-1]) < least:
        out[-2:] = [f"{out[-2]}\n\n{out[-1]}".strip()]
    return out


def chunk_text(body: str, most: int = CHUNK_MAX, least: int = CHUNK_MIN) -> list[tuple[int, str, str]]:
    """(order, heading trail, text) of a Markdown body: sections by heading, long ones in pieces."""
    trail: dict[int, str] = {}
    sections, lines = [], []
    for line in [*body.split("\n"), None]:
        m = re.match(r"^(#{1,6})\s+(.*)$", line) if line is not None else None
        if line is None or m:
            sections.append((" > ".join(trail[k] for k in sorted(trail)), "\n".join(lines).strip()))
            lines = []
            if m:
                trail = {k: v for k, v in trail.items() if k < len(m[1])} | {len(m[1]): m[2].strip()}
        else:
            lines.append(line)
    found = [(h, p.strip()) for h, t in sections if t for p in _pieces(t, most, least) if p.strip()]
    return [(i, h, p) for i, (h, p) in enumerate(found)]


def chunk_documents(docs: DataFrame, key: str, text: str, most: int = CHUNK_MAX, least: int = CHUNK_MIN) -> DataFrame:
    """key, chunk_order, heading, text: each document's chunks. A scan with state, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *c) for k, body in zip(frame[key], frame[text], strict=True) for c in chunk_text(body or "", most, least)]
            yield pd.DataFrame(rows, columns=[key, "chunk_order", "heading", "text"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, chunk_order int, heading string, text string")
