"""Defective prompt and response pairs.

Refusals are found by recurrence, without a list of phrases. Every sentence of a
response is reduced to a template: names become one mark, numbers of the prompt another,
citations go. A response with a number that is not of the prompt says something and is
no candidate. Distinct templates are clustered by MinHash over five-word
shingles (16 bands of 4 rows), every link verified (Jaccard 0.8 or more), and clusters
are the connected components of the links. A cluster refuses if it stands under
unrelated prompts (of several patterns, none with three quarters of them), consists of
whole sentences, and names nothing that the reference answer of its prompt names: it
recurs whatever is asked and gives nothing of what was asked for. A response is a
refusal if all its sentences are in such clusters. Spans quoted from papers give no
evidence, as a shared passage recurs too; they are labelled like the rest.

Copy, language and termination checks label the remaining defects. Whether a sentence
without a stop is whole is decided by counts over the sentences of the corpus that end
with one: how often its last word, and its pattern (function words, numbers,
placeholders), ends a sentence, and how often a sentence goes on there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 16, 4

# Fixed word lists: frequent function words of the languages told apart.
FUNCTION = {
    "en": "the a an of in on at to for from with without by and or but that which who is are was were be been has have had it its this these those they their we our not no than then when if so as into over under after before between each more most only how what why does did do can could will would such there one some any both either neither nor once while because although unless until per whose yet yes still even all",
    "de": "der die das den dem des ein eine einer eines einem einen und oder aber nicht ist sind war waren wird werden wurde wurden mit von vom zu zum zur für auf aus bei nach über unter durch ohne um als wie dass weil wenn während sich auch nur noch er sie es wir ich man hat haben hatte im in an am kein keine dabei damit jede jeder alle bis ab sowie etwa je lediglich mir dieser diese ihm kann was welche warum",
    "fr": "le la les l un une des du de d et ou mais ne pas est sont était ont a à au aux en dans par pour sur avec sans que qui quoi dont où ce cette ces il elle ils elles nous vous je se sa son ses leur plus moins même très chaque tandis comme entre après avant lors n y tout quel quelle quels combien pourquoi lui",
    "es": "el la los las un una unos unas de del y o pero no es son era fue fueron se en con sin por para que como más menos muy su sus al lo le les esta este estas estos según mientras aunque cuando entre sobre hasta desde cada ha han he también ya porque qué cuál cuántas cuántos esa ese quedó",
    "pt": "o a os as um uma uns umas de do da dos das e ou mas não é são era foi foram se em no na nos nas com sem por para que como mais menos muito seu sua ao à pelo pela esta este essa esse até cada entre sobre após mas já também porque só há pois enquanto usa ficou qual quantas",
    "pl": "i w z ze na do o od po za przez dla nie jest są był była było były się że który która które co jak lub oraz ale a to ten ta te tym tego jego jej ich tylko gdy gdzie podczas przy bez pod nad między jednak również około których tych każdy czy",
}
WORDS = {k: frozenset(v.split()) for k, v in FUNCTION.items()}
EVERY = frozenset().union(*WORDS.values())
#: Words that no sentence of these languages ends with.
OPEN_END = frozenset("the a an of in on at to for from with by and or but that which who is are was were be than if so as into over under between each when because although while der die das den dem des ein eine einer und oder mit von zu für auf aus bei le la les un une des du de et ou que qui à en dans par pour sur avec el los las una del y con por para o os as um uma do da e em no na com i w z na do od po za przez dla że и в на с по не что".split())
PLACEHOLDER = frozenset("null none nil nan na n a n/a n.a. undefined missing empty blank tbd tba todo answer a response leer vacío vide keine".split()) - {"a"}
WRAPPER = re.compile(r"</?[A-Za-z][\w-]{0,20}\s*/?>|^\s*(?:answer|response|a)\s*:|\\boxed\{\s*\}", re.I)
COPY_EXTRA = frozenset("q a question answer you asked your the is was query prompt frage antwort question réponse pregunta respuesta pergunta resposta pytanie odpowiedź вопрос ответ 问题 回答 to repeat user asks asked".split())
LETTER, HAN, HAN_RUN, CYRILLIC, WORD = (regex.compile(x) for x in (r"\p{L}", r"\p{Han}", r"\p{Han}{4}", r"\b\p{Cyrillic}+\b", r"[\p{L}\p{M}]+"))
PLAIN_WORD = re.compile(r"[^\W\d_]+")
#: Letters and marks that hardly occur outside one of the languages; names hold accents too, so these are few.
MARKS = {"pl": frozenset("ąęłśżź"), "es": frozenset("¿¡"), "pt": frozenset("õ"), "de": frozenset("ß"), "fr": frozenset(), "en": frozenset()}
LANGUAGES: dict[str, tuple[str, ...]] = {w: tuple(k for k, v in WORDS.items() if w in v) for w in EVERY}
SENTENCE = regex.compile(r"(?<=[.!?。！？])[\"'”’»)\]]*(?:\s*\[\d+\])*\s+|(?<=[。！？])|\n+")
TERMINAL = regex.compile(r"(?:[.!?。！？…][\"'”’»)\]*`]*|\[\d+\][.\]]*|```)$")
#: A number that is no part of a name.
DIGITS = re.compile(r"(?<![\w\-’'])\d+(?:[.,]\d+)*")
TOKEN = regex.compile(r"\d+(?:[.,]\d+)*|[\p{L}\p{M}]+(?:['’\-][\p{L}\p{M}\d]+)*|\p{P}|\p{S}")
BLANK = regex.compile(r"[\s\p{C}\p{Z}\p{P}\p{S}]+")
TITLE = re.compile(r"[“„«\"][^”“»\"\n]+[”“»\"]")
#: A formula that ends the text: a relation, and no operator at its end.
FORMULA = regex.compile(r"[=≤≥≈<>]\s*[^=≤≥≈<>]*[\d\p{L})²³]$")
BARE = regex.compile(r"^[^\s]+(?:\s+[^\s]+){0,2}$|^[-−]?\d[\d.,]*\s*\S{0,12}\s*\([^()]*\)$")


#: Four words in plain letters: no blank and, if no longer a placeholder, no empty answer.
SAYS = re.compile(r"[^\W\d_]{2}\w*\W+[^\W\d_]\w*\W+[^\W\d_]\w*\W+[^\W\d_]")


def is_empty(answer: str | None) -> bool:
    """Null, blank, invisible or punctuation only, an empty wrapper, or a placeholder for no value."""
    if answer is None:
        return True
    if "<" not in answer and "\\" not in answer and SAYS.search(answer):
        return False
    rest = WRAPPER.sub(" ", answer)
    words = BLANK.sub(" ", rest).strip().lower()
    return not words or rest.strip().lower().strip(".!\"'()[]{}<>* ") in PLACEHOLDER or words in ("n a", "null", "none", "nan", "nil")


@lru_cache(4096)
def _words(question: str) -> tuple[list[str], frozenset[str]]:
    q = regex.findall(r"[\p{L}\p{M}\p{N}]+", question.lower())
    return q, frozenset(q) | COPY_EXTRA


COPY_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def is_copy(question: str | None, answer: str) -> bool:
    """Nothing but the question, whatever its case, marks and wrapping words."""
    if not question:
        return False
    q, known = _words(question)
    if not q:
        return False
    a = []
    for m in COPY_WORD.finditer(answer):
        w = m.group().lower()
        if w not in known:
            return False
        a.append(w)
    rest, i, found = 0, 0, False
    while i < len(a):
        if a[i : i + len(q)] == q:
            found, i = True, i + len(q)
        else:
            if a[i] not in COPY_EXTRA or (rest := rest + 1) > 6:
                return False
            i += 1
    return found


@lru_cache(4096)
def language(text: str) -> str | None:
    """The language of a text, if its script or function words leave no doubt."""
    text = TITLE.sub(" ", text)
    score = dict.fromkeys(WORDS, 0)
    if not text.isascii():
        letters = len(LETTER.findall(text))
        if not letters:
            return None
        if HAN_RUN.search(text) and len(HAN.findall(text)) * 4 >= letters:
            return "zh"
        cyr = CYRILLIC.findall(text)
        if len(cyr) >= 3 and sum(map(len, cyr)) * 3 >= letters:
            return "ru"
        for lang, marks in MARKS.items():
            score[lang] += 2 * sum(1 for c in text if c in marks)
    for w in PLAIN_WORD.findall(text.lower()):
        for lang in LANGUAGES.get(w, ()):
            score[lang] += 1
    (best, n), (_, second) = sorted(score.items(), key=lambda x: -x[1])[:2]
    return best if n >= 2 and n > 1.25 * second else None


def pattern(sentence: str) -> str:
    """Function words, numbers and marks of a sentence; a placeholder for runs of other words."""
    out: list[str] = []
    for t in TOKEN.findall(sentence):
        low = t.lower()
        p = "#" if t[0].isdigit() else low if low in EVERY or not (t[0].isalpha()) else "x"
        if p == "x" and out and out[-1] == "x":
            continue
        out.append(p)
    while out and out[-1] in ".!?。！？":
        out.pop()
    return " ".join(out)


@lru_cache(4096)
def prompt(question: str) -> str:
    return pattern(question)


CITED = re.compile(r"\[\d+\]")
#: Words a template must hold to be more than a bare yes or no.
LEAST_WORDS = 3


@lru_cache(4096)
def _held(question: str) -> frozenset[str]:
    return frozenset(t.lower() for t in TOKEN.findall(question))


def templates(question: str, answer: str, reference: str | None) -> tuple[list[str], list[bool], list[bool]] | None:
    """The template of each sentence, whether it names what the reference answer names, and whether it ends with a stop.

    None if a sentence holds a number that is not of the prompt: it says something of its own.
    """
    known = _held(question)
    text = CITED.sub(" ", answer)
    if any(n not in known for n in DIGITS.findall(text)):
        return None
    out, own, stopped = [], [], []
    for s in SENTENCE.split(text):
        words, names = [], []
        for t in TOKEN.findall(s):
            if t[0].isdigit():
                words.append("#")
            elif t[0].isalpha():
                low = t.lower()
                if len(t) > 3 and low != t and low not in EVERY and (words or low in known or t.isupper() or any(c.isdigit() for c in t)):
                    words.append("N")
                    if low not in known:
                        names.append(t)
                else:
                    words.append(low)
        if words:
            out.append(" ".join(words))
            own.append(bool(reference) and any(n in reference for n in names))
            stopped.append(bool(TERMINAL.search(s.rstrip())))
    return (out, own, stopped) if out else None


@lru_cache(1 << 16)
def _token(t: str) -> tuple[int, int, str, bool]:
    """Hash of a token as a place in a pattern (0 for a placeholder), hash with names masked, the word if in lower case, whether a sentence may end after it."""
    low = t.lower()
    alpha = t[0].isalpha()
    p = "#" if t[0].isdigit() else low if low in EVERY or not alpha else "x"
    word = low if alpha and low == t else ""
    last = p if p != "x" else word or "N"
    return (0 if p == "x" else xxhash.xxh64_intdigest(p)), xxhash.xxh64_intdigest(last), word, p == "#" or (last not in OPEN_END and last[0].isalnum())


_MASK, _STEP, _PATH, _LAST = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def _steps(sentence: str) -> tuple[list[int], list[tuple[int, int, str, bool]]]:
    """For each token of a sentence before its stop the hash of the pattern up to it, and the tokens."""
    tokens = TOKEN.findall(sentence)
    while tokens and tokens[-1] in ".!?。！？…":
        tokens.pop()
    told = [_token(t) for t in tokens]
    paths, path, was = [], 1, 1
    for p, _, _, _ in told:
        if p or was:
            path = (path * _STEP + (p or 7)) & _MASK
        was = p
        paths.append(path)
    return paths, told


def evidence_keys(sentence: str) -> list[int]:
    """Keys of the last word, of the pattern with the last word, and of the pattern alone."""
    paths, told = _steps(sentence)
    if not told:
        return []
    path, (_, last, word, _) = paths[-1], told[-1]
    return [xxhash.xxh64_intdigest("word\n" + word), ((path ^ last) * _LAST) & _MASK, (path * _PATH) & _MASK]


class Evidence:
    """key, ends, goes_on: how often what a key stands for ends a stopped sentence (is a whole word), and how often it goes on.

    Steps at which no sentence is asked for (after OPEN_END, marks) are not counted.
    """

    def __init__(self):
        self.ends: Counter = Counter()
        self.goes: Counter = Counter()
        self.words: Counter = Counter()

    def add(self, sentence: str) -> None:
        paths, told = _steps(sentence)
        if not told:
            return
        self.words.update([t[2] for t in told])
        end = paths[-1]
        self.ends.update([((end ^ told[-1][1]) * _LAST) & _MASK, (end * _PATH) & _MASK])
        inner = [(path, t[1]) for path, t in zip(paths[:-1], told) if t[3]]
        self.goes.update({((path ^ last) * _LAST) & _MASK for path, last in inner} | {(path * _PATH) & _MASK for path, _ in inner if path != end})

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        begun: Counter = Counter()
        for w, n in self.words.items():
            if w:
                self.ends[xxhash.xxh64_intdigest("word\n" + w)] += n
                for i in range(1, len(w)):
                    begun[w[:i]] += n
        for w, n in begun.items():
            self.goes[xxhash.xxh64_intdigest("word\n" + w)] += n
        keys = list(self.ends.keys() | self.goes.keys())
        return np.array(keys, np.uint64).view(np.int64), np.array([self.ends[k] for k in keys], np.int64), np.array([self.goes[k] for k in keys], np.int64)


def whole_ends(ask: DataFrame, counts: DataFrame) -> DataFrame:
    """ask: the asked ends (a column ask of keys) that are whole by the first evidence there is.

    A last word that is the beginning of other words 50 times as often as a word is
    cut. Else the pattern with the last word decides, else the pattern alone, by the
    more frequent of ending and going on: shares, so more data does not shift them.
    """
    asked = written(ask.distinct().select("ask", F.posexplode("ask").alias("at", "key")))
    wanted = counts.join(asked.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
    got = asked.join(wanted, "key")
    n = lambda c, k: F.coalesce(F.max(F.when(F.col("at") == k, F.col(c))), F.lit(0))
    g = got.groupBy("ask").agg(*[n(c, k).alias(f"{c}{k}") for k in range(3) for c in ("ends", "goes_on")])
    at = F.when(F.col("ends1") + F.col("goes_on1") > 0, F.col("ends1") > F.col("goes_on1")).otherwise(F.col("ends2") > F.col("goes_on2"))
    return g.where((F.col("goes_on0") <= 50 * F.col("ends0")) & at).select("ask")


def end_state(answer: str) -> tuple[str, str]:
    """("whole", ""), ("broken", "") or ("ask", the last sentence)."""
    t = answer.rstrip()
    if t.count("```") % 2:
        return "broken", ""
    if TERMINAL.search(t):
        return "whole", ""
    body = t.rstrip("*_`\"'”’» ")
    if any(body.count(a) > body.count(b) for a, b in ("()", "[]", "{}", "“”", "«»")):
        return "broken", ""
    last = body.rsplit("\n", 1)[-1].strip()
    words = regex.findall(r"[\p{L}\p{M}\d]+", last)
    if not words or body[-1] in ",;:-–—=+×/·√≤≥<>(" or (words[-1].lower() in OPEN_END and len(words) > 1):
        return "broken", ""
    if regex.match(r"^\s*(?:[-*•·–+]|\d+[.)])\s", last):
        return ("whole", "") if regex.search(r"[:=]\s*\S", last) or not regex.search(r"\n\s*(?:[-*•·–+]|\d+[.)])\s[^\n]*[:=]\s*\S", body) else ("broken", "")
    if last == body and BARE.match(last):
        return "whole", ""
    if FORMULA.search(last):
        return "whole", ""
    return "ask", SENTENCE.split(last)[-1]


@lru_cache(None)
def _coefficients() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, (2, BANDS * ROWS), np.uint64) | np.uint64(1)


def shingles(template: str) -> frozenset[str]:
    words = template.split()
    return frozenset(" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1)))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """band, template: a row for each band of the MinHash signature."""
    coef = _coefficients()
    for batch in batches:
        bands = [np.zeros(0, np.uint64)]
        for t in batch.column(0).to_pylist():
            x = np.array([xxhash.xxh64_intdigest(g) for g in shingles(t)], np.uint64)
            sig = ((x[:, None] * coef[0] + coef[1]) >> np.uint64(32)).min(0).reshape(BANDS, ROWS)
            mixed = np.arange(1, BANDS + 1, dtype=np.uint64)
            for k in range(ROWS):
                mixed = (mixed ^ sig[:, k]) * np.uint64(_STEP)
                mixed ^= mixed >> np.uint64(29)
            bands.append(mixed)
        of = np.repeat(np.arange(batch.num_rows), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bands).view(np.int64)), batch.column(0).take(pa.array(of))], ["band", "template"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of similarity ``SIMILAR`` within runs of equal band: every member with each head it resembles, or a head of its own."""
    at, heads = None, []
    for batch in batches:
        left, right = [], []
        for band, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if band != at:
                at, heads = band, []
            mine, linked = shingles(t), False
            for head, other in heads:
                if t != head and len(mine & other) >= SIMILAR * len(mine | other):
                    left.append(head), right.append(t)
                    linked = True
            if not linked:
                heads.append((t, mine))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["a", "b"])


def clusters(one: DataFrame) -> DataFrame:
    """template, cluster: the connected components of the verified links, named by their least template. ``one`` holds distinct templates."""
    bands = one.select("template").mapInArrow(_bands, "band bigint, template string")
    several = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    bands = bands.join(several, "band", "left_semi").repartition("band").sortWithinPartitions("band", "template")
    links = written(bands.mapInArrow(_verified, "a string, b string").distinct())
    label = one.select("template", F.col("template").alias("cluster"))
    if links.isEmpty():
        return label
    both = written(links.union(links.select("b", "a")))
    label = written(label)
    while True:
        least = both.join(label, both.b == label.template).groupBy("a").agg(F.min("cluster").alias("near"))
        step = label.join(least, label.template == least.a, "left").select("template", F.least("cluster", F.coalesce("near", "cluster")).alias("next"), "cluster")
        jump = label.select(F.col("template").alias("next"), F.col("cluster").alias("far"))
        moved = written(step.join(jump, "next").select("template", F.least("next", "far").alias("to"), "cluster"))
        done = moved.where("to <> cluster").isEmpty()
        label = moved.select("template", F.col("to").alias("cluster"))
        if done:
            return label


def refusal_templates(uses: DataFrame, least_prompts: int = 2, most_of_one: float = 0.75, most_own: float = 0.1) -> DataFrame:
    """template: those of clusters that refuse. ``uses``: template, own, stopped, prompt (the pattern of the question), one row per use."""
    per = written(uses.groupBy("template", "prompt").agg(F.count("*").alias("n"), F.count_if("own").alias("own"), F.count_if("stopped").alias("stopped")))
    of = clusters(per.select("template").distinct())
    g = per.join(of, "template").groupBy("cluster", "prompt").agg(F.sum("n").alias("n"), F.sum("own").alias("own"), F.sum("stopped").alias("stopped"))
    g = g.groupBy("cluster").agg(F.count("*").alias("prompts"), F.max("n").alias("most"), *[F.sum(c).alias(c) for c in ("n", "own", "stopped")])
    g = g.where((F.col("prompts") >= least_prompts) & (F.col("most") <= most_of_one * F.col("n")) & (F.col("own") <= most_own * F.col("n")) & (F.col("stopped") * 2 > F.col("n")))
    return of.join(g.select("cluster"), "cluster", "left_semi").where(F.size(F.split("template", " ")) >= LEAST_WORDS).select("template")


_FIELDS = {
    "table_name": pa.string(), "record_key": pa.string(), "field_name": pa.string(), "label": pa.string(), "prompt": pa.string(), "ask": pa.list_(pa.int64()),
    "templates": pa.list_(pa.string()), "own": pa.list_(pa.bool_()), "stopped": pa.list_(pa.bool_()), "key": pa.int64(), "ends": pa.int64(), "goes_on": pa.int64(),
}
_SCHEMA = "table_name string, record_key string, field_name string, label string, prompt string, ask array<bigint>, templates array<string>, own array<boolean>, stopped array<boolean>, key bigint, ends bigint, goes_on bigint"


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are or may be defective, and rows of evidence (key, ends, goes_on) on the ends of sentences.

    label: a defect that is certain; "broken" and "open" are truncated unless the row refuses, "open" also unless its end (ask) is whole.
    """
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("row", "label", "prompt", "ask", "templates", "own", "stopped")}
        seen = Evidence()
        for k, (q, a, ref) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)))):
            label, ask, told = None, None, None
            if is_empty(a):
                label = "empty"
            else:
                for s in SENTENCE.split(a):
                    if s and TERMINAL.search(s.rstrip()):
                        seen.add(s)
                if is_copy(q, a):
                    label = "copied_question"
                else:
                    lq = language(q or "")
                    la = language(a) if lq else None
                    if la and lq != la:
                        label = "other_language"
                    else:
                        state, end = end_state(a)
                        label = {"whole": None, "broken": "broken", "ask": "open"}[state]
                        ask = [_signed(x) for x in evidence_keys(end)] if state == "ask" else None
                        told = templates(q or "", a, ref)
            if label or told:
                out["row"].append(k), out["label"].append(label), out["prompt"].append(prompt(q or "") if told else None), out["ask"].append(ask)
                for c, v in zip(("templates", "own", "stopped"), told or (None, None, None)):
                    out[c].append(v)
        rows = pa.array(out.pop("row"), pa.int64())
        cols = {c: batch.column(c).take(rows) for c in ("table_name", "record_key", "field_name")} | {c: pa.array(v, _FIELDS[c]) for c, v in out.items()}
        yield _batch(cols, len(rows))
        keys, ends, goes = seen.arrays()
        yield _batch({"key": pa.array(keys), "ends": pa.array(ends), "goes_on": pa.array(goes)}, len(keys))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _batch(cols: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(n, t) for c, t in _FIELDS.items()], list(_FIELDS))


def pairs_of(dataset: DataFrame, rows: DataFrame) -> DataFrame:
    """question, answer, reference (another answer to the question), table_name, record_key, field_name of every pair.

    Rows repeated under a key count once (of different ones the least as a whole). A null key part counts as empty.
    """
    q = dataset.where("qid is not null").groupBy("qid").agg(F.min(F.struct("question", "ideal_answer", "answer_span")).alias("q")).select("qid", "q.*")
    d = q.select("question", F.expr("stack(2, 'ideal_answer', ideal_answer, answer_span, 'answer_span', answer_span, ideal_answer) as (field_name, answer, reference)"), F.lit("dataset").alias("table_name"), F.col("qid").alias("record_key"))
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("parser", "chunker", "qid")]
    r = rows.where("error is null").select("qid", "answer", F.concat_ws("|", *parts).alias("record_key"))
    r = r.groupBy("record_key").agg(F.min(F.struct("qid", "answer")).alias("r")).select("record_key", "r.*")
    r = r.join(q.select("qid", "question", F.col("ideal_answer").alias("reference")), "qid", "left").select("question", F.lit("answer").alias("field_name"), "answer", "reference", F.lit("rag_round2_rows").alias("table_name"), "record_key")
    return d.unionByName(r).select("question", "answer", "reference", "table_name", "record_key", "field_name")


def defects(dataset: DataFrame, rows: DataFrame) -> DataFrame:
    """table_name, record_key, field_name, defect of every defective pair.

    Order of the checks: empty, copied_question, other_language, refusal, truncated.
    A pair whose question is unknown can be empty, a refusal or truncated only.
    """
    parts = int(dataset.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not joined again: the work is in the texts, not in their bytes
    every = written(pairs_of(dataset, rows).repartition(parts).mapInArrow(_labels, _SCHEMA))
    counts = every.where("key is not null").select("key", "ends", "goes_on")
    name = ["table_name", "record_key", "field_name"]
    rows = every.where("table_name is not null")
    told = rows.where("templates is not null")
    uses = told.where("field_name <> 'answer_span'").select("prompt", F.explode(F.arrays_zip("templates", "own", "stopped")).alias("t")).select("prompt", F.col("t.templates").alias("template"), "t.own", "t.stopped")
    refusing = refusal_templates(uses)
    said = told.select(*name, F.explode(F.array_distinct("templates")).alias("template"), F.size(F.array_distinct("templates")).alias("all"))
    refused = written(said.join(refusing, "template").groupBy(*name, "all").agg(F.count("*").alias("n")).where("n = `all`").select(*name))
    certain = rows.where("label in ('empty', 'copied_question', 'other_language')").select(*name, F.col("label").alias("defect"))
    cut = rows.where("label in ('broken', 'open')").join(refused, name, "left_anti").select(*name, "label", "ask")
    unsure = cut.where("label = 'open'")
    unsure = unsure.join(whole_ends(unsure.select("ask"), counts), "ask", "left_anti")
    broken = cut.where("label = 'broken'").select(*name).union(unsure.select(*name))
    return certain.union(refused.withColumn("defect", F.lit("refusal"))).union(broken.withColumn("defect", F.lit("truncated")))
