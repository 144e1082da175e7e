"""Text expressions: names, labels, message checks, snippets."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from .. import schema as S


def as_col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _ascii_of(ch: str) -> str:
    return unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode("ascii")


def _folding() -> dict[str, str]:
    """ASCII part of the compatibility form of every character that has one."""
    found = {chr(c): _ascii_of(chr(c)) for c in range(0x80, 0x110000) if unicodedata.decomposition(chr(c))}
    return {ch: plain for ch, plain in found.items() if plain}


_FOLD = _folding()
_FOLD_ONE = {ch: plain for ch, plain in _FOLD.items() if len(plain) == 1}
_FOLD_MORE = {ch: plain for ch, plain in _FOLD.items() if len(plain) > 1}


def _char_class(chars: Iterable[str]) -> str:
    """Pattern for one of these non-ASCII characters, as ranges; others are told apart by one comparison.

    Java compares a character with each member of a class in turn, so members are few and ASCII comes first.
    """
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return r"[[^\x00-\x7F]&&[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]]"


_MORE_CLASS = _char_class(_FOLD_MORE)


def fold_ascii(col: Column | str) -> Column:
    """ASCII form of a text: accents removed, ligatures and signs spelt out, other non-ASCII dropped.

    Characters that stand for one letter are translated; those that stand for
    several are looked for and each different one is replaced in one pass. ASCII texts are left alone.
    """
    text = as_col(col)
    one = F.translate(text, "".join(_FOLD_ONE), "".join(_FOLD_ONE.values()))
    spelt = F.map_from_arrays(
        F.array(*[F.lit(ch) for ch in _FOLD_MORE]), F.array(*[F.lit(plain) for plain in _FOLD_MORE.values()])
    )
    signs = F.array_distinct(F.regexp_extract_all(one, F.lit(_MORE_CLASS), F.lit(0)))
    out = F.aggregate(signs, one, lambda s, ch: F.replace(s, ch, F.element_at(spelt, ch)))
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(out, r"[^\x00-\x7F]", ""))


def slugify(col: Column | str) -> Column:
    """ASCII snake_case of a name."""
    return F.btrim(F.regexp_replace(F.lower(fold_ascii(col)), "[^a-z0-9]+", "_"), F.lit("_"))


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(as_col(path), "/"), -1)


def parse_station_filename(col: Column | str) -> Column:
    """Struct (original, slug) from a station file name, null when it does not fit."""
    name = F.trim(F.regexp_extract(as_col(col), S.STATION_FILE_PATTERN, 1))

    def pair(n: Column) -> Column:
        return _once(slugify(n), lambda slug: F.when(slug != "", F.struct(n.alias("original"), slug.alias("slug"))))

    return _once(name, pair)


def label_lookup(col: Column | str, labels: dict, default: Column | None = None) -> Column:
    """Literal map lookup; unknown values fall back to their text."""
    value = as_col(col)
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), value)
    return F.coalesce(found, default if default is not None else value.cast("string"))


def month_label(col: Column | str) -> Column:
    return label_lookup(as_col(col).cast("int"), S.MONTH_NAMES)


def horizon_label(col: Column | str) -> Column:
    value = as_col(col).cast("int")
    return label_lookup(value, S.HORIZON_LABELS, F.concat(value.cast("string"), F.lit("h")))


# --- fixed values: message patterns -------------------------------------------
INJECTION_PATTERNS = [
    r"(ignore|forget|disregard|override)\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|rules?|prompts?)",
    r"(you are now|act as|pretend (you are|to be)|from now on you)",
    r"(new\s+system\s+prompt|repeat\s+your\s+(instructions?|system\s+prompt|prompt))",
]
EXFILTRATION_PATTERNS = [
    r"(google_api_key|openai_api_key|secret|password|token|credential)\s*(=|:|\s)",
    r"(print|show|reveal|expose|leak|dump|output|repeat|return)\s+.{0,40}(api.?key|secret|password|token|env(ironment)?\s*var)",
]
# Words of which every match of the pattern at the same place above holds one.
INJECTION_WORDS = [
    ["ignore", "forget", "disregard", "override"],
    ["you are now", "act as", "pretend", "from now on you"],
    ["system", "repeat"],
]
EXFILTRATION_WORDS = [
    ["api_key", "secret", "password", "token", "credential"],
    ["api", "secret", "password", "token", "env"],
]
# Characters other than a-z that equal a letter when case is ignored.
CASE_TWINS = "ſKİı"
CPF_PATTERN = r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b"
EMAIL_PATTERN = r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"
PHONE_PATTERN = r"(?:\+55\s?)?\(?\d{2}\)?\s?\d{4,5}[-\s]?\d{4}\b"
SYSTEM_LITERALS = [
    "Você é um assistente meteorológico",
    "Regras para escolha de tool",
    "Períodos do dia:",
]
API_KEY_PATTERN = r"AIza[0-9A-Za-z\-_]{35}"
INJECTION_REASON = "Padrão de injeção detectado: '{}'"
EXFILTRATION_REASON = "Padrão de exfiltração detectado: '{}'"
PII_REASON = "Dado pessoal (CPF, e-mail ou telefone) detectado na mensagem."
SYSTEM_REASON = "Fragmento do system prompt detectado na resposta: '{}'"
API_KEY_REASON = "Padrão de API key Google detectado na resposta."
# --- end of fixed values --------------------------------------------------------

_PII_PATTERNS = {"cpf": CPF_PATTERN, "email": EMAIL_PATTERN, "phone": PHONE_PATTERN}


def _once(value: Column, fn) -> Column:
    """``fn`` of a value that is worked out once per row."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _verdict(hits: list[Column], rules: list[tuple[str, str]]) -> Column:
    """Struct of the first rule that is hit; a text without a hit passed.

    One conditional, so that the rules run in compiled code and stop at the first hit.
    """
    found = F.lit(None).cast("struct<passed: boolean, threat_type: string, reason: string>")
    for i, (kind, why) in enumerate(rules):
        row = F.struct(F.lit(False).alias("passed"), F.lit(kind).alias("threat_type"), F.lit(why).alias("reason"))
        found = F.when(hits[i], row) if i == 0 else found.when(hits[i], row)
    nothing = F.struct(
        F.lit(True).alias("passed"), F.lit(None).cast("string").alias("threat_type"), F.lit("").alias("reason")
    )
    return found.otherwise(nothing)


def check_input(col: Column | str) -> Column:
    """Struct (passed, threat_type, reason) for an incoming message.

    A search for plain words, or for three digits in a row, comes before each
    pattern and spares it on most texts; the pattern alone decides. Texts of one-byte
    characters need no Unicode rules.
    """
    text = as_col(col)
    patterns = [*INJECTION_PATTERNS, *EXFILTRATION_PATTERNS]
    words = [*INJECTION_WORDS, *EXFILTRATION_WORDS]
    plain = F.octet_length(text) == F.length(text)

    def matches(pattern: str, flags: str = "") -> Column:
        ascii_flags = f"(?{flags})" if flags else ""
        return F.when(plain, text.rlike(ascii_flags + pattern)).otherwise(text.rlike(f"(?{flags}{'u' if flags else ''}U)" + pattern))

    twins = ~plain & text.rlike(f"[{CASE_TWINS}]")
    hits = []
    for pattern, needed in zip(patterns, words):
        possible = F.lower(text).contains(needed[0])
        for word in needed[1:]:
            possible = possible | F.lower(text).contains(word)
        hits.append((possible | twins) & matches(pattern, "i"))
    digits = matches(r"\d{3}")
    hits.append(digits & matches(CPF_PATTERN))
    hits.append(text.contains("@") & matches(EMAIL_PATTERN))
    hits.append(digits & matches(PHONE_PATTERN))
    rules = [("prompt_injection", INJECTION_REASON.format(p[:60])) for p in INJECTION_PATTERNS]
    rules += [("exfiltration", EXFILTRATION_REASON.format(p[:60])) for p in EXFILTRATION_PATTERNS]
    rules += [("pii", PII_REASON)] * 3
    return _verdict(hits, rules)


def detect_pii(col: Column | str) -> Column:
    """Struct with the number of matches per kind of personal data."""
    text = as_col(col)
    return F.struct(
        *[F.regexp_count(text, F.lit("(?U)" + p)).alias(k) for k, p in _PII_PATTERNS.items()]
    )


def check_output(col: Column | str) -> Column:
    """Struct (passed, threat_type, reason) for an answer; flags only."""
    text = as_col(col)
    hits = [text.contains(lit) for lit in SYSTEM_LITERALS] + [text.rlike(API_KEY_PATTERN)]
    rules = [("system_leak", SYSTEM_REASON.format(lit)) for lit in SYSTEM_LITERALS]
    rules.append(("api_key_leak", API_KEY_REASON))
    return _verdict(hits, rules)


def strip_text(col: Column | str) -> Column:
    """Whitespace of any kind removed at both ends."""
    return F.regexp_replace(as_col(col), r"(?U)^\s+|\s+$", "")


def validate_message(col: Column | str, max_chars: int = S.MAX_MESSAGE_CHARS) -> Column:
    """Struct (status, threat_type) of a message: empty, too_long, blocked or ok."""
    text = strip_text(col)

    def verdict(t: Column) -> Column:
        status = F.when(t == "", "empty").when(F.length(t) > max_chars, "too_long")
        threat = F.when(status.isNull(), check_input(t)["threat_type"])
        return _once(
            F.struct(status.alias("s"), threat.alias("t")),
            lambda v: F.struct(
                F.coalesce(v["s"], F.when(v["t"].isNotNull(), "blocked"), F.lit("ok")).alias("status"),
                v["t"].alias("threat_type"),
            ),
        )

    return _once(text, verdict)


def split_snippets(col: Column | str, sep: str = "\n\n") -> Column:
    """Parts of a joined text without the blank ones."""
    return F.filter(F.split(as_col(col), sep), lambda x: strip_text(x) != "")


def join_snippets(parts: Column | str, sep: str = "\n\n", empty: str = S.NO_CONTEXT_TEXT) -> Column:
    """One text from an array of snippets; a fixed sentence when there is none."""
    arr = as_col(parts)
    return F.when(F.coalesce(F.size(arr), F.lit(0)) > 0, F.array_join(arr, sep)).otherwise(
        F.lit(empty)
    )


def request_key(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by a colon."""
    return F.sha2(F.concat_ws(":", *[as_col(p).cast("string") for p in parts]), 256)


# --- fixed values: anchor link scores ------------------------------------------
LINK_SCORES = {"token_in_href": 2, "year_in_href": 4, "year_in_text": 3, "whole_word": 1}


def link_score(href: Column, text: Column, year: Column, token: str) -> Column:
    """Score of an archive link for a year; the token must be in the address."""
    href_l, text_l = F.lower(href), F.lower(text)
    word = F.regexp_like(F.concat(href, F.lit(" "), text), F.concat(F.lit(r"\b"), year, F.lit(r"\b")))

    def points(hit: Column, name: str) -> Column:
        return F.when(hit, LINK_SCORES[name]).otherwise(0)

    return (
        points(href_l.contains(token), "token_in_href")
        + points(href_l.contains(year), "year_in_href")
        + points(text_l.contains(year), "year_in_text")
        + points(word, "whole_word")
    )
