"""Text read in a wrong character encoding: found, and restored where it can be.

Garbled words are joined with their near-twins elsewhere in the corpus: words of equal
text once the characters beyond ASCII are taken out. Words and pairs of words without
ASCII letters have nothing left then; they are joined on the pattern in which their
characters repeat, which no misreading changes (for UTF-8 the pattern of their pairs of
characters). Twins are aligned character by character. A run that has as many characters
as its twin has bytes in UTF-8 tells which byte each character was read from; runs of
equal length tell which character stands for which. What explains the alignments is
learned: readings in an encoding of the Python library (all one-byte encodings are
tried, alone for UTF-8 and in pairs), the one that explains most words first and others
only for words left over; and, where no encoding of the library explains enough words,
the bare map from characters to bytes. No list says which encodings occur.

The mappings learned are applied to every record, again while something comes off (text
garbled twice). Replacement characters have lost their byte; such words are restored
from the one sound twin that fits all around the gaps, if there is one.
"""

from __future__ import annotations

import pkgutil
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from encodings import __path__ as ENCODINGS
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: How UTF-8 was read: an encoding of the library, or the learned (character, byte) pairs.
Reading = str | tuple[tuple[str, int], ...]
RUN = re.compile(r"([A-Za-z]?)([^\x00-\x7f]{2,})(?=([A-Za-z]?))")
LETTER = re.compile("[A-Za-z]")
LOST = "�"
PLAUSIBLE = re.compile(
    "[ -ɏ̀-̧̨̄̈̊̌Ά-ώϑϕЁ-ЏА-џҐґḀ-ỿ -―‘-•… ‰′″‹›€⁰-₎℀-⋿─-◿☀-➿　-ヿ一-鿿가-힯＀-￯️​-‍﻿\U0001f300-\U0001faff]+"
)
CYRILLIC = re.compile("[Ѐ-џ]")
#: Russian words and quotes as they are: no sign of a wrong reading, whatever bytes they have.
SOUND = re.compile("[А-яЁё«»„“”‘’–—…]+|[一-鿿　-〿＀-￯]+")
MIXED = re.compile("[а-яё][А-ЯЁ]")
VOWELS = frozenset("аеёиоуыэюя")
CYRILLIC_WORD = re.compile("[А-яЁё]+")


@lru_cache(None)
def table(codec: Reading) -> dict[str, int]:
    """Characters to bytes; bytes an encoding leaves open stand for their own number."""
    if not isinstance(codec, str):
        return dict(codec)
    out: dict[str, int] = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


@lru_cache(None)
def sequences(codec: Reading) -> re.Pattern:
    """Characters that, read back as bytes, are UTF-8 sequences."""
    of: dict[int, str] = {}
    for ch, b in table(codec).items():
        of.setdefault(b, re.escape(ch))
    cls = lambda a, z: "[" + ("".join(of[b] for b in range(a, z + 1) if b in of) or "^\\s\\S") + "]"
    c = cls(0x80, 0xBF)
    return re.compile(f"(?:{cls(0xC2, 0xDF)}{c}|{cls(0xE0, 0xEF)}{c}{c}|{cls(0xF0, 0xF4)}{c}{c}{c})+")


def unread(run: str, codec: Reading, known: bool = False, glued: bool = False) -> str | None:
    """A run of such characters as the text it was, if that is plausible; ``known``: the text shows this encoding elsewhere; ``glued``: a plain letter, or a passage taken back, stands beside it."""
    t = table(codec)
    if SOUND.fullmatch(run) and not glued and not (known and MIXED.search(run)):
        return None
    try:
        out = bytes(t[ch] for ch in run).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None
    if not PLAUSIBLE.fullmatch(sequences(codec).sub("é", out)) or (len(out) == 1 and not known and CYRILLIC.match(out)):
        return None
    return out


def _mend_sequences(text: str, codecs: tuple[Reading, ...]) -> tuple[str, int]:
    """Text with the garbled UTF-8 sequences of one encoding taken back, that which explains most of the text (of equals the first), and how many there were."""
    runs = Counter(RUN.findall(text))
    best, most = None, 0
    for codec in codecs:
        pat = sequences(codec)
        n = 0
        for (before, run, after), k in runs.items():
            for m in pat.finditer(run):
                glued = bool(before) and m.start() == 0 or bool(after) and m.end() == len(run)
                if unread(m.group(), codec, glued=glued) is not None:
                    n += k * len(m.group())
        if n > most:
            best, most = codec, n
    if best is None:
        return text, 0
    done, last = 0, -9

    def back(m: re.Match) -> str:
        nonlocal done, last
        a, b = m.span()
        glued = a > 0 and LETTER.match(text, a - 1) is not None or LETTER.match(text, b) is not None
        out = unread(m.group(), best, True, glued or a - last == 1)
        if out is None:
            return m.group()
        done += 1
        last = b
        return out

    return sequences(best).sub(back, text), done


def _russian(word: str) -> bool:
    low = word.lower()
    body = word[1:]
    return bool(re.fullmatch("[А-яЁё]+", word)) and (body == body.lower() or word == word.upper()) and any(c in VOWELS for c in low) and sum(c in VOWELS for c in low) <= len(low) * 0.7


QUOTES = "«»„“”‘’–—…"


def _russian_word(word: str) -> bool:
    """As ``_russian``, within quotes and with hyphens."""
    parts = word.strip(QUOTES).split("-")
    return any(len(p) > 2 for p in parts) and all(_russian(p) if len(p) > 2 else CYRILLIC_WORD.fullmatch(p) for p in parts)


def _looks_sound(word: str) -> bool:
    return all(SOUND.fullmatch(p) for p in word.split("-") if p)


#: Words as they stand between ASCII marks; other blanks may be letters read wrongly.
ODD_WORD = re.compile(r"[^\x00-\x2c./:;<=>?@\[\]\\^_`{|}~]+")
def _mend_letters(text: str, pairs: tuple[tuple[str, str], ...]) -> tuple[str, int]:
    """Russian in one 8-bit encoding that was read in another: words of nothing but odd characters that turn into Russian ones.

    Words of one or two characters, and such as look sound, go with the words around them.
    """
    words = [m for m in ODD_WORD.finditer(text) if not m.group().isascii()]
    odd = [m.group() for m in words if len(m.group()) >= 3 and not _looks_sound(m.group()) and not re.search("[0-9A-Za-z一-鿿]", m.group())]
    if not odd:
        return text, 0
    count = Counter(odd)
    best, most = None, 0
    for pair in pairs:
        n = sum(k for w, k in count.items() if _russian_word(_reread(w, pair)))
        if n > most:
            best, most = pair, n
    if best is None or most * 2 <= len(odd):
        return text, 0
    taken = [len(m.group()) >= 3 and not _looks_sound(m.group()) and _russian_word(_reread(m.group(), best)) for m in words]
    before = [False] * len(words)
    after = [False] * len(words)
    for k in range(1, len(words)):
        before[k] = taken[k - 1] or (before[k - 1] and len(words[k - 1].group()) <= 2)
    for k in range(len(words) - 2, -1, -1):
        after[k] = taken[k + 1] or (after[k + 1] and len(words[k + 1].group()) <= 2)
    out, at, done = [], 0, 0
    for k, m in enumerate(words):
        w = m.group()
        new = _reread(w, best)
        sound = _looks_sound(w)
        near = (before[k] and after[k]) or ((before[k] or after[k]) and not sound)
        if new != w and (taken[k] or near and not re.search("[0-9A-Za-z]", w) and w not in "×÷" and re.fullmatch(f"[А-яЁё{QUOTES}]+|[^А-яЁё]*[А-яЁё]{{2,}}[^А-яЁё]*", new) and CYRILLIC.search(new)):
            out.append(text[at : m.start()])
            out.append(new)
            at = m.end()
            done += 1
    return "".join(out) + text[at:], done


def _natural(word: str) -> bool:
    return word[1:] == word[1:].lower()


def _vowels(words: list[str]) -> float:
    n = sum(map(len, words))
    return sum(c in VOWELS for w in words for c in w.lower()) / n if n else 0.0


def _reread(word: str, pair: tuple[str, str]) -> str:
    try:
        return word.encode(pair[0]).decode(pair[1])
    except (UnicodeEncodeError, UnicodeDecodeError):
        return word


def _mend_cyrillic(text: str, pairs: tuple[tuple[str, str], ...]) -> tuple[str, int]:
    """Cyrillic words of turned case that hold few vowels as they stand, and as many as Russian has if read again.

    Capitals alone are no sign: headings and shouted words have their vowels.
    """
    words = [w for w in CYRILLIC_WORD.findall(text) if len(w) >= 3]
    odd = [w for w in words if not _natural(w)]
    if len(odd) < 3:
        return text, 0
    before, whole = _vowels(odd), len(words) - len(odd) < 0.2 * len(odd)
    best, most = None, max(0.33, 0.0 if before < 0.3 else before + 0.05 if whole else 1.0)
    for pair in pairs:
        again = [_reread(w, pair) for w in odd]
        if _vowels(again) >= most and sum(map(_natural, again)) >= 0.9 * len(again):
            best, most = pair, _vowels(again)
    if best is None:
        return text, 0
    done = 0

    def back(m: re.Match) -> str:
        nonlocal done
        w = m.group()
        if whole or not _natural(w) or (len(w) < 3 and w.isupper()):
            done += 1
            return _reread(w, best)
        return w

    return CYRILLIC_WORD.sub(back, text), done


def mend(text: str, codecs: tuple[Reading, ...] | None = None, pairs: tuple[tuple[str, str], ...] | None = None) -> tuple[str, int]:
    """The text as it was, and how many passages were taken back, by the readings given (all of the library, if none are)."""
    codecs = one_byte() if codecs is None else codecs
    pairs = cyrillic_pairs() if pairs is None else pairs
    total = 0
    while True:
        text, n = _mend_letters(text, tuple(p for p in pairs if not _turned(p)))
        text, m = _mend_sequences(text, codecs)
        total += n + m
        if not m:
            break
    text, n = _mend_cyrillic(text, tuple(p for p in pairs if _turned(p)))
    return text, total + n


def _bare(word: str) -> str:
    return re.sub(r"[^\x00-\x7f]+", "", word)


def pattern(text: str, unit: int = 1) -> str:
    """In which order characters (or groups of ``unit`` characters) repeat; blanks stay."""
    seen: dict[str, int] = {}
    return " ".join(",".join(str(seen.setdefault(w[i : i + unit], len(seen))) for i in range(0, len(w), unit)) for w in text.split(" "))


#: What a pair of words must hold for its pattern to tell something: characters, and repetitions among them.
LETTERS, REPEATS = 9, 3


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of a batch that hold characters beyond ASCII, with what is left of them without those; and pairs of words of nothing else, with their pattern."""
    for batch in batches:
        forms: Counter = Counter()
        two: Counter = Counter()
        for text in batch.column(0).to_pylist():
            last = ""
            for w in ASCII_BLANK.split(text):
                if w.isascii():
                    last = ""
                    continue
                w = w.strip(EDGE)
                if len(w) > 1:
                    forms[w] += 1
                word = "" if ASCII.search(w) else w
                if last and word and not CJK.search(word):
                    two[f"{last} {word}"] += 1
                last = word
        rows = [(0, _bare(w), w, n) for w, n in forms.items()]
        for w, n in two.items():
            for unit in (1, 2):
                a, b = w.split(" ")
                if len(a) % unit or len(b) % unit or (unit == 2 and len(set(a[::2] + b[::2])) > 6):
                    continue
                parts = [x[i : i + unit] for x in (a, b) for i in range(0, len(x), unit)]
                if len(parts) >= LETTERS and len(parts) - len(set(parts)) >= REPEATS:
                    rows.append((unit, pattern(w, unit), w, n))
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.string(), pa.int64()))], ["unit", "bare", "form", "n"])


def forms(documents: DataFrame) -> DataFrame:
    """unit, bare, form, n. unit 0: the words of the corpus that hold characters beyond ASCII, and what else they hold.

    unit 1 and 2: pairs of words of nothing but such characters, with the pattern of
    characters, or of pairs of characters, in which they repeat.
    """
    src = documents.where(F.col("text").rlike(r"[^\x00-\x7f]")).select("text")
    return src.mapInArrow(_forms, "unit int, bare string, form string, n bigint").groupBy("unit", "bare", "form").agg(F.sum("n").alias("n"))


ASCII_BLANK = re.compile(r"[\x00-\x20]+")
ASCII = re.compile("[\x21-\x7e]")
CJK = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef]")
EDGE = ".,;:!?()[]{}\"'*_`<>|=#"
WORD = re.compile(r"[^\s" + re.escape(EDGE) + "]+")
#: The pairs named first win where several explain the same words.
FIRST = ("cp1252", "cp1250", "cp1251", "latin-1", "iso8859-2", "iso8859-15", "koi8-r", "cp866", "cp437", "cp850", "mac_roman", "mac_cyrillic")


@lru_cache(None)
def one_byte() -> tuple[str, ...]:
    """Every one-byte encoding of the library that agrees with ASCII, once each."""
    seen, out = set(), []
    for codec in (*FIRST, *sorted(m.name for m in pkgutil.iter_modules(ENCODINGS))):
        try:
            if bytes(range(128)).decode(codec) != "".join(map(chr, range(128))) or len(bytes(range(128, 256)).decode(codec, "replace")) != 128:
                continue
            key = tuple(table(codec).items())
        except (LookupError, UnicodeError, TypeError):
            continue
        if key not in seen and len(key) == 128:
            seen.add(key), out.append(codec)
    return tuple(out)


@lru_cache(None)
def grid() -> tuple[tuple[str, str], ...]:
    """All pairs (read in, really in) of one-byte encodings."""
    return tuple((a, b) for a in one_byte() for b in one_byte() if a != b)


@lru_cache(None)
def reading(read: str, real: str) -> dict[str, str]:
    """Characters as they were read, to what they were."""
    of = {b: ch for ch, b in table(real).items()}
    return {ch: of[b] for ch, b in table(read).items()}


@lru_cache(None)
def _turned(pair: tuple[str, str]) -> bool:
    """Whether a pair of encodings reads Russian letters as Russian letters."""
    of = reading(*pair)
    return sum(bool(re.match("[А-я]", of.get(c, ""))) for c in "абвгдежзийклмнопрстуфхцчшщъыьэюя") >= 28


@lru_cache(None)
def cyrillic_pairs() -> tuple[tuple[str, str], ...]:
    """The pairs of encodings that can make Russian words of what they read."""
    holds = lambda c: sum(0x430 <= ord(ch) <= 0x44F for ch in table(c)) == 32
    return tuple((a, b) for a, b in grid() if holds(b) and not (holds(a) and all(table(a)[ch] == table(b)[ch] for ch in "абвя")))


@lru_cache(None)
def _byte_of() -> dict[tuple[str, int], int]:
    """(character read, byte): the one-byte encodings that read it so, as bits."""
    out: dict[tuple[str, int], int] = {}
    for k, codec in enumerate(one_byte()):
        for sub in table(codec).items():
            out[sub] = out.get(sub, 0) | 1 << k
    return out


@lru_cache(None)
def _explains() -> dict[tuple[str, str], int]:
    """(character read, character meant): the pairs of the grid that explain it, as bits."""
    out: dict[tuple[str, str], int] = {}
    for k, (a, b) in enumerate(grid()):
        for sub in reading(a, b).items():
            out[sub] = out.get(sub, 0) | 1 << k
    return out


def latin(word: str) -> bool:
    """Nothing but Latin letters, with apostrophes and hyphens between them."""
    return all((c.isalpha() and (c.isascii() or unicodedata.name(c, "").startswith("LATIN") and c not in "ªº")) or c in "'’-" for c in word) and any(c.isalpha() for c in word)


NONASCII = re.compile(r"[^\x00-\x7f]+")
UTF8, BARE = "utf-8", "bytes"


def _bits(value: int) -> Iterator[int]:
    while value > 0:
        low = value & -value
        yield low.bit_length() - 1
        value ^= low


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each form and sound twin what turns all of the one into the other.

    kind utf-8: encodings UTF-8 was read in (numbers of ``one_byte``), "bytes": the
    substitutions that none of them explains; latin, other: pairs of ``grid``.
    """
    for batch in batches:
        rows: list[tuple] = []
        for unit, form, sound, n, m in zip(*(batch.column(i).to_pylist() for i in range(5))):
            runs = list(zip(NONASCII.findall(form), NONASCII.findall(sound)))
            if any(len(a) != len(b.encode("utf-8", "surrogatepass")) for a, b in runs):
                runs = []
            subs = {(ch, byte) for a, b in runs for ch, byte in zip(a, b.encode("utf-8", "surrogatepass"))}
            if subs and not re.search(LOST, form):
                bits = -1
                for sub in subs:
                    bits &= _byte_of().get(sub, 0)
                told = sorted(f"{ch}{byte:02x}" for ch, byte in subs)
                rows += [(form, UTF8, True, k, told, sound) for k in _bits(bits)] or [(form, BARE, True, -1, told, sound)]
                continue
            if len(form) != len(sound) or m < n:
                continue
            mixed = not latin(form)
            if unit == 0 and (not latin(sound) or m == n or (not mixed and m < 10 * n)):
                continue
            bits = -1
            for sub in zip(form, sound):
                if not sub[0].isascii() or sub[0] != sub[1]:
                    bits &= _explains().get(sub, 0)
            told = sorted({a + b for a, b in zip(form, sound) if a != b})
            if bits <= 0 or (unit == 0 and (mend(form, one_byte(), ())[1] or mend(sound, one_byte(), ())[1])):  # a sequence of UTF-8
                continue
            rows += [(form, "other" if unit else "latin", mixed, k, told, sound) for k in _bits(bits)]
        cols = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.list_(pa.string()), pa.string()))], ["form", "kind", "mixed", "pair", "subs", "sound"])


def aligned(words: DataFrame) -> DataFrame:
    """form, kind, mixed, pair, subs, sound: forms with a twin that has other characters beyond ASCII in the same places, and what explains them."""
    w = words.where(~F.contains("form", F.lit(LOST)) & ((F.col("unit") > 0) | F.col("bare").rlike("[A-Za-z].*[A-Za-z]")))
    # pairs of characters stand against characters
    mask = F.when(F.col("unit") == 0, F.regexp_replace("form", r"[^\x00-\x7f]+", "\u0001")).otherwise(F.col("bare"))
    w = w.select("unit", "form", "n", mask.alias("mask"))
    sound = w.where("unit < 2").select((F.col("unit") > 0).alias("pattern"), "mask", F.col("form").alias("sound"), F.col("n").alias("m"))
    two = w.withColumn("pattern", F.col("unit") > 0).join(sound, ["pattern", "mask"]).where("form <> sound and (m >= n or length(form) > length(sound))")
    return two.select("unit", "form", "sound", "n", "m").mapInArrow(_align, "form string, kind string, mixed boolean, pair int, subs array<string>, sound string").distinct()


def _greedy(signatures: list[tuple[tuple[int, ...], int]], least: int) -> list[int]:
    """Explanations by the number of forms that none before explains, while there are ``least``; of equals the first."""
    out: list[int] = []
    left = dict(signatures)
    while left:
        n: Counter = Counter()
        for sig, k in left.items():
            n.update(dict.fromkeys(sig, k))
        best, most = min(n.items(), key=lambda x: (-x[1], x[0]))
        if most < least:
            break
        out.append(best)
        left = {sig: k for sig, k in left.items() if best not in sig}
    return out


def learned(twins: DataFrame, least: int = 2) -> tuple[tuple[Reading, ...], tuple[tuple[str, str], ...]]:
    """(readings of UTF-8, pairs of one-byte encodings for words without Latin letters) that explain ``least`` forms which none before them explains.

    To the driver come sums only: one per set of encodings that explain a form, and one
    per character and byte for what no encoding explains.
    """
    sets = twins.where("kind in ('utf-8', 'other')").groupBy("kind", "form").agg(F.sort_array(F.collect_set("pair")).alias("s")).groupBy("kind", "s").agg(F.count("*").alias("n")).collect()
    pick = lambda kind: _greedy([(tuple(r["s"]), r["n"]) for r in sets if r["kind"] == kind], least)
    codecs: list[Reading] = [one_byte()[k] for k in pick(UTF8)]
    known = tuple(codecs)

    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Without twins of which either is garbled in a way that is known."""
        for batch in batches:
            yield batch.filter(pa.array([not any(mend(x, known, ())[1] for x in two) for two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.bool_()))

    odd = twins.where(F.col("kind") == BARE).select("form", "sound", "subs").mapInArrow(unknown, "form string, sound string, subs array<string>")
    odd = odd.select("form", F.explode("subs").alias("sub")).groupBy("sub").agg(F.count_distinct("form").alias("n")).collect()
    seen: dict[str, Counter] = {}
    for r in odd:
        seen.setdefault(r["sub"][0], Counter())[int(r["sub"][1:], 16)] += r["n"]
    bare = {ch: c.most_common(1)[0] for ch, c in seen.items() if c.most_common(1)[0][1] >= 0.9 * c.total()}
    by_byte: dict[int, tuple[int, str]] = {}
    for ch, (byte, n) in bare.items():
        by_byte[byte] = max(by_byte.get(byte, (0, "")), (n, ch))
    sure = [b for b, (n, _) in by_byte.items() if n >= least]  # the rest stands beside them in the same forms
    if len(sure) >= 3 and any(b >= 0xC2 and by_byte[b][0] > least for b in sure) and any(b < 0xC0 for b in sure):
        codecs.append(tuple(sorted((ch, b) for b, (_, ch) in by_byte.items())))
    return tuple(codecs), tuple(grid()[k] for k in pick("other") if grid()[k] in cyrillic_pairs())


def mappings(twins: DataFrame, least: int = 3) -> dict[int, set[str]]:
    """Pairs of ``grid`` that explain ``least`` words in Latin letters by ``least`` substitutions, most forms first, with the characters they explain.

    At most one row per pair and character comes to the driver.
    """
    twins = twins.where("kind = 'latin'")
    n = twins.groupBy("pair").agg(F.count_distinct("form").alias("forms"))
    chars = twins.select("pair", F.explode("subs").alias("sub")).groupBy("pair").agg(F.collect_set("sub").alias("subs"))
    rows = n.join(chars, "pair").where((F.col("forms") >= least) & (F.size("subs") >= least)).collect()
    return {r["pair"]: {x[0] for x in r["subs"]} for r in sorted(rows, key=lambda r: (-r["forms"], r["pair"]))}


def confirmed(src: DataFrame, twins: DataFrame, known: dict[int, set[str]]) -> DataFrame:
    """h (hash of a text), pair, confirmed: the texts that hold confirmed words, and the pair that explains most of them.

    One word that no single script explains is enough; of words in Latin letters it takes two, with two substitutions.
    """
    chars = frozenset().union(*known.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, form = [], []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if chars.isdisjoint(text):
                    continue
                odd = {x for w in ASCII_BLANK.split(text) if not w.isascii() and not chars.isdisjoint(w) and len(x := w.strip(EDGE)) > 1}
                at += [h] * len(odd)
                form += odd
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(form, pa.string())], ["h", "form"])

    order = F.create_map(*[F.lit(x) for k, p in enumerate(known) for x in (p, -k)])
    held = src.select("h", "text").mapInArrow(run, "h bigint, form string").distinct()
    hits = held.join(twins.where((F.col("kind") == "latin") & F.col("pair").isin(*known)), "form")
    g = hits.groupBy("h", "pair").agg(F.collect_set("form").alias("confirmed"), F.max("mixed").alias("mixed"), F.size(F.array_distinct(F.flatten(F.collect_list("subs")))).alias("subs"))
    g = g.where("mixed or (size(confirmed) >= 2 and subs >= 2)")
    best = F.max_by(F.struct("pair", "confirmed"), F.struct(F.size("confirmed"), order[F.col("pair")])).alias("b")
    return g.groupBy("h").agg(best).select("h", "b.pair", "b.confirmed")


def _mend_words(text: str, pair: tuple[str, str], known: set[str]) -> tuple[str, int]:
    """Text with the confirmed words read again, and those beside that only this makes words in Latin letters.

    Short words without a plain letter go with them, unless the text holds more Cyrillic words than odd ones.
    """
    to, done = reading(*pair), 0
    words = WORD.findall(text)
    odd = sum(w in known for w in words)
    alone = sum(len(w) >= 3 and bool(CYRILLIC_WORD.fullmatch(w)) for w in words) < odd

    def back(m: re.Match) -> str:
        nonlocal done
        w = m.group()
        if w.isascii():
            return w
        out = "".join(c if c.isascii() else to.get(c, c) for c in w)
        if out == w or not (w in known or (not latin(w) and latin(out) and (re.search("[A-Za-z]", w) or alone and len(w) <= 2 and w.isalpha()))):
            return w
        done += 1
        return out

    return WORD.sub(back, text), done


def _apply(codecs: tuple[Reading, ...], pairs: tuple[tuple[str, str], ...], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, count, lost, mended = [], [], [], []
            for k, (text, pair, known) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))):
                out, n = mend(text, codecs, pairs)
                if pair is not None:
                    out, more = _mend_words(out, grid()[pair], set(known))
                    n += more
                gone = out.count(LOST)
                if n or gone:
                    keep.append(k), count.append(n), lost.append(gone), mended.append(out)
            cols = [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(count, pa.int32()), pa.array(lost, pa.int32())]
            names = ["doc_id", "passages", "lost"]
            if with_text:
                cols.append(pa.array(mended, pa.string())), names.append("restored")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def garbled(documents: DataFrame, with_text: bool = False, words: DataFrame | None = None) -> DataFrame:
    """doc_id, passages taken back, characters lost (and the restored text) of every garbled document.

    A document without garbled passages does not come out. Null and empty texts, and
    texts of plain ASCII, hold none. Repeated rows come out repeatedly.
    """
    words = written(forms(documents)) if words is None else words
    twins = written(aligned(words))
    codecs, pairs = learned(twins)
    kind = documents.schema["doc_id"].dataType.simpleString()
    src = documents.where(F.col("text").rlike(r"[^\x00-\x7f]")).select("doc_id", "text")
    known = mappings(twins)
    if known:
        src = src.withColumn("h", F.xxhash64("text"))
        src = src.join(written(confirmed(src, twins, known)), "h", "left").select("doc_id", "text", "pair", "confirmed")
    else:
        src = src.withColumns({"pair": F.lit(None).cast("int"), "confirmed": F.lit(None).cast("array<string>")})
    return src.mapInArrow(_apply(codecs, pairs, with_text), f"doc_id {kind}, passages int, lost int" + ", restored string" * with_text)


def _gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forms with replacement characters beside a sound twin: kept if each gap takes one character or more beyond ASCII."""
    for batch in batches:
        ok = []
        for form, twin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            pat = "".join(r"[^\x00-\x7f]" if part.startswith(LOST) else re.escape(part) for part in re.findall(f"{LOST}+|[^{LOST}]+", form))
            ok.append(bool(re.fullmatch(pat, twin)))
        yield batch.filter(pa.array(ok))


def gap_words(words: DataFrame) -> DataFrame:
    """form, sound: words with lost characters that exactly one sound form of the corpus fits (or one ten times as frequent as the rest)."""
    words = words.where("unit = 0")
    lost = words.where(F.contains("form", F.lit(LOST)) & (F.length("bare") >= 2)).select("bare", "form")
    sound = words.where(~F.contains("form", F.lit(LOST))).select("bare", F.col("form").alias("sound"), "n")
    fits = lost.join(sound, "bare").select("form", "sound", "n").mapInArrow(_gaps, "form string, sound string, n bigint")
    best = fits.groupBy("form").agg(F.max(F.struct("n", "sound")).alias("b"), F.sum("n").alias("all"))
    return best.where("b.n * 11 >= `all` * 10").select("form", F.col("b.sound").alias("sound"))


def restored(documents: DataFrame) -> DataFrame:
    """doc_id, passages, lost, still_lost, restored: garbled documents with their text as far as it can be had."""
    words = written(forms(documents))
    bad = written(garbled(documents, True, words).withColumn("row", F.monotonically_increasing_id()))
    hit = bad.where("lost > 0").select("row", F.explode(F.array_distinct(F.regexp_extract_all("restored", F.lit(r"([^\s.,;:!?()\[\]{}\"'*_`<>|=#]*" + LOST + r"[^\s.,;:!?()\[\]{}\"'*_`<>|=#]*)"), F.lit(1)))).alias("form"))
    fix = hit.join(gap_words(words), "form").groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.length("form").alias("l"), "form", "sound")), asc=False).alias("fix"))
    out = bad.join(fix, "row", "left")
    text = F.expr("aggregate(coalesce(fix, array()), restored, (t, f) -> replace(t, f.form, f.sound))")
    out = out.withColumn("restored", text)
    return out.select("doc_id", "passages", "lost", (F.length("restored") - F.length(F.replace("restored", F.lit(LOST), F.lit("")))).alias("still_lost"), "restored")
