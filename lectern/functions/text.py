"""Text normalisation as column expressions. Regexes run in the JVM; only compatibility normalisation needs Python."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.parts import by_parts, by_values
from lectern.options import TextOptions

#: Marks a place inside expressions; private-use characters are gone after clean_characters().
MARK = "\ue000"
#: Takes texts and their language, gives as many texts.
Verbaliser = Callable[[list[str], str], list[str]]
#: Letters, digits and the underscore, as Python's \w has them.
_WORD = r"\p{L}\p{N}_"


def _ranges(points: list[int]) -> list[tuple[int, int]]:
    """First and last of each run of ascending numbers."""
    ranges, start = [], None
    for a, b in zip([*points], [*points[1:], -1]):
        start = a if start is None else start
        if b != a + 1:
            ranges.append((start, a))
            start = None
    return ranges


def _class(ranges: list[tuple[int, int]], sign: str = "") -> str:
    return f"[{sign}" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


#: Corner brackets and the quotes that they become.
_QUOTES = str.maketrans("「」『』", "“”“”")


@lru_cache(maxsize=1)
def changing_class() -> str:
    """Regex class of corner brackets and of the characters that NFKC changes, orders or puts together: it leaves texts without any as they are."""
    points = [c for c in range(0x80, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    pairs = (unicodedata.decomposition(chr(c)).split() for c in points)
    second = {int(p[1], 16) for p in pairs if len(p) == 2 and not p[0].startswith("<")} | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3), *_QUOTES}
    found = [c for c in points if c in second or unicodedata.combining(chr(c)) or unicodedata.normalize("NFKC", chr(c)) != chr(c)]
    calm = [r for r in _ranges(sorted({*points} - {*found})) if r[1] - r[0] > 64]
    # the first range answers for ASCII, long ones for nearly all other characters
    return f"[\\x{{80}}-\\x{{10ffff}}&&{_class(calm, '^')}&&{_class(_ranges(found))}]"


def normalize_unicode(text: Column) -> Column:
    """Corner brackets become double quotes, then NFKC; only rows that this may change reach Python."""
    changing = F.when(F.regexp_like(text, F.lit(changing_class())), text)
    return F.coalesce(by_values(changing, lambda t: unicodedata.normalize("NFKC", t.translate(_QUOTES)), "string", pa.string()), text)


@lru_cache(maxsize=1)
def pictograph_class() -> str:
    """Regex class of emoji shown as pictures and of drawing, geometric and symbol blocks, from the Unicode property."""
    points = [c for c in range(0x2300, 0x1FB00) if regex.match(r"\p{Emoji_Presentation}", chr(c))]
    return _class([*_ranges(points), (0x2500, 0x25FF), (0x2600, 0x26FF), (0x1F300, 0x1F5FF)])


# In the classes the first part answers for nearly every character.
def clean_characters(text: Column) -> Column:
    """Runs of what is no letter, number, punctuation, symbol or white space become a space, then runs of pictographs."""
    kept = F.regexp_replace(text, r"(?U)[[^\x20-\x7E]&&[^\p{L}\p{N}\p{P}\p{S}\s\x1C-\x1F]]+", " ")
    return F.regexp_replace(kept, f"[\\x{{2300}}-\\x{{1fb00}}&&{pictograph_class()}]+", " ")


def _if(text: Column, held: Callable[[Column], Column], rule: Callable[[Column], Column]) -> Column:
    """A rule for texts of which `held` says that it may change them."""
    return F.get(F.transform(F.array(text), lambda t: F.when(held(t), rule(t)).otherwise(t)), F.lit(0))  # what a lambda is given is computed once


def _has(*signs: str) -> Callable[[Column], Column]:
    """Whether a text has one of `signs`: a search of bytes."""
    return lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(s)) for s in signs])


def _where(text: Column, signs: tuple[str, ...], pattern: str, new: str) -> Column:
    """A pattern for texts that have one of `signs`."""
    return _if(text, _has(*signs), lambda t: F.regexp_replace(t, pattern, new))


#: White space as the JVM's Unicode classes have it, and four separators.
SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


# The patterns of normalize_whitespace().
def normalize_whitespace(text: Column) -> Column:
    """One kind of line end; runs of spaces become one; blank lines become one paragraph break."""
    out = _where(text, ("\r",), r"\r\n?", "\n")
    out = _where(out, ("  ", "\t"), r"[ \t]+", " ")
    lines = lambda t: F.regexp_replace(F.regexp_replace(t, r"(?U)\s*\n\n\s*", MARK), r"(?U)\s*\n\s*", "\n")
    out = _if(out, lambda t: F.regexp_like(t, F.lit(r"(?U)\n(?:(?=\s)|(?<=\s\n))")), lines)
    return strip(F.replace(out, F.lit(MARK), F.lit("\n\n")))


def scene_breaks(text: Column, least: int = 3) -> Column:
    """A line of at least so many marks and nothing else is a paragraph break."""
    other = f"[^{_WORD}\\n]"
    return F.regexp_replace(text, f"(?mUd)^(?=(?:{other}*?[^{_WORD}\\s]){{{least}}}){other}+$", "\n\n")


# The patterns of repeated_punctuation(), collapse_stutter() and strip_emphasis().
def repeated_punctuation(text: Column) -> Column:
    rules = [(("!?", "?!"), r"(?:!\?|\?!){2,}", "?!"), (("--",), "--+", "—"), (("....",), r"\.{4,}", "..."), (("!!!", "???", ",,,", ";;;", ":::"), r"([!?,;:])\1{2,}", "$1")]
    for rule in rules:
        text = _where(text, *rule)
    return text


def repeated_letters(text: Column, limit: int) -> Column:
    return F.regexp_replace(text, f"(?i)([a-zA-Z])\\1{{{limit},}}", "$1" * limit)


def repeated_symbols(text: Column, limit: int) -> Column:
    return F.regexp_replace(text, f"(?U)([^{_WORD}\\s.?!—,:;])\\1{{{limit},}}", "$1" * limit)


def global_style(text: Column, o: TextOptions) -> Column:
    """Scene breaks, punctuation, letters, symbols: each as the options have it, in this order."""
    if o.normalize_scene_breaks:
        text = scene_breaks(text, o.min_scene_break_length)
    if o.normalize_repeated_punctuation:
        text = repeated_punctuation(text)
    if o.max_repeated_alpha_chars is not None:
        text = repeated_letters(text, o.max_repeated_alpha_chars)
    if o.max_repeated_symbol_chars is not None:
        text = repeated_symbols(text, o.max_repeated_symbol_chars)
    return text


def remove_brackets(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\[[^\n]*?\]", ""), r"\([^\n]*?\)", "")


def collapse_stutter(text: Column) -> Column:
    inner = lambda t: _has("-", ".")(F.rtrim(t, F.lit(".")))
    return _if(text, inner, lambda t: F.regexp_replace(t, r"(?iU)\b([A-Za-z])(?:[-.]\1)+", "$1"))


def strip_emphasis(text: Column) -> Column:
    return _where(_where(text, ("**", "__"), r"(\*\*|__)(.+?)\1", "$2"), ("*", "_"), r"(\*|_)(.+?)\1", "$2")


def one_space(text: Column) -> Column:
    """One space between words, none around them."""
    other = F.lit(r"(?U)[[^\x20-\x7E]&&[\s\x1C-\x1F]]")
    return F.trim(_if(text, lambda t: F.contains(t, F.lit("  ")) | F.regexp_like(t, other), lambda t: F.regexp_replace(t, r"(?U)[\s\x1C-\x1F]+", " ")))


def full_stop(flat: Column) -> Column:
    """A full stop unless a terminator ends the text, quotes aside; texts of quotes alone stay. `flat` is used twice: bind it first where it is dear."""
    last = F.substring(F.rtrim(flat, F.lit(" \"'’”")), -1, 1)  # the empty string is in any other
    return F.when(F.instr(F.lit(".?!"), last) == 0, F.concat(flat, F.lit("."))).otherwise(flat)


def finish_sentence(text: Column) -> Column:
    """One space between words, and a full stop unless a terminator ends it, quotes aside."""
    return full_stop(one_space(text))


def prepared(text: Column, o: TextOptions) -> Column:
    """Everything that comes before segmentation."""
    out = global_style(normalize_whitespace(clean_characters(normalize_unicode(text))), o)
    return remove_brackets(out) if o.remove_bracketed_text else out


#: Abbreviations after which a full stop ends no sentence, by language.
ABBREVIATIONS = {"en": ("Mr", "Mrs", "Ms", "Dr", "Prof"), "de": ("Hr", "Fr", "Dr", "Prof", "bzw"), "fr": ("Mme", "Mlle"), "es": ("Sra", "Srta")}


def split_sentences(paragraph: Column, language: str = "en") -> Column:
    """Sentences of a paragraph: cut after a terminator (and a closing quote) before white space, and at line feeds."""
    known = "|".join(ABBREVIATIONS.get(language, ()))
    guard = f"(?<!\\b(?:{known})\\.)" if known else ""
    cut = F.regexp_replace(paragraph, f"(?U)([.?!][\"'’”)]?){guard}\\s+", "$1" + MARK)
    return F.filter(F.split(cut, f"[\\n{MARK}]+"), lambda s: s != "")


def verbalised(paragraphs: Column, verbalise: Verbaliser, language: str) -> Column:
    """Sentences of all paragraphs of a part of a batch through a hook that takes and gives a list of texts."""

    def rule(values: list) -> list:
        texts = iter(verbalise([s for ps in values if ps is not None for p in ps for s in p], language))
        return [None if ps is None else [[next(texts) for _ in p] for p in ps] for ps in values]

    return by_parts(paragraphs, rule, "array<array<string>>", pa.list_(pa.list_(pa.string())))


def sentences(text: Column, o: TextOptions, verbalise: Verbaliser | None = None, split: Callable[[Column], Column] | None = None) -> Column:
    """Array of paragraphs, each an array of finished sentences, of a prepared text.

    `verbalise` may spell out numbers, dates and the like before sentences are finished;
    `split` cuts a paragraph instead of split_sentences().
    Each step is a transform() of its own: what a lambda is given is computed once.
    """

    def local(s: Column) -> Column:
        if o.normalize_stuttering:
            s = collapse_stutter(s)
        return strip_emphasis(s) if o.normalize_emphasis else s

    def finished(s: Column) -> Column:
        return F.trim(F.lower(full_stop(s))) if o.to_lowercase else full_stop(s)

    cut = split or (lambda p: split_sentences(p, o.text_language))
    each = lambda ps, rule: F.transform(ps, lambda p: F.transform(p, rule))
    paragraphs = F.filter(F.split(text, r"\n\n+"), lambda p: p != "")
    found = F.transform(paragraphs, lambda p: F.transform(cut(p), local))
    if verbalise is not None:
        found = verbalised(found, verbalise, o.text_language)
    done = each(each(found, one_space), finished)
    return F.filter(F.transform(done, lambda p: F.filter(p, lambda s: s != "")), lambda p: F.size(p) > 0)
