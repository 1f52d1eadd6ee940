"""Markup in text: which kinds there are, and clean text that keeps the structure.

Marks are read from one scan per text, outside code. Signs that two kinds share go to
the kind of the rest. Cleaning turns a text into words and tags; on whole HTML pages
the content region is the contiguous stretch of maximum score, words counting for
and tags against it (a linear scan), with what lies between it and the next tag of
layout on either side. The weights come from pages of the table that label their
content themselves (<main>, <article>; ``weights``), or are the defaults below.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("html", "markdown", "wiki", "latex")

# Element names, environments and commands of the kinds.
TAGS = "a abbr acronym address applet area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr ref references nowiki gallery math".split()
ENTITIES = "amp|lt|gt|quot|apos|nbsp|ndash|mdash|hellip|[lr][ds]quo|[lr]aquo|[sb]dquo|bull|middot|copy|reg|trade|deg|times|divide|plusmn|micro|para|sect|euro|pound|yen|cent|ensp|emsp|thinsp|zwnj|zwj|shy|iexcl|iquest|frac\\d\\d|sup\\d|ord[fm]|larr|rarr|uarr|darr|harr|le|ge|ne|asymp|infin|sum|prod|radic|minus|[A-Za-z]{1,2}(?:grave|acute|circ|tilde|uml|cedil|caron|slash|lig|ring)|szlig|eth|thorn|alpha|beta|gamma|delta|epsilon|lambda|mu|pi|sigma|tau|phi|omega|theta|eta|Sigma|Omega|Delta"
BARE_COMMANDS = "alpha|beta|gamma|delta|epsilon|varepsilon|zeta|eta|theta|iota|kappa|lambda|mu|nu|xi|pi|rho|sigma|tau|upsilon|phi|varphi|chi|psi|omega|Gamma|Delta|Theta|Lambda|Xi|Pi|Sigma|Phi|Psi|Omega|times|cdot|leq|geq|le|ge|neq|approx|sim|infty|sum|prod|int|partial|nabla|in|to|rightarrow|leftarrow|Rightarrow|ldots|dots|quad|qquad|item|maketitle|newpage|clearpage|noindent|centering|tableofcontents|hline|toprule|midrule|bottomrule|textwidth|linewidth|par|bf|it|em|tt|small|large|left|right|max|min|log|exp|sin|cos|sqrt|frac|cite|ref|label|emph|appendix|bibliography"
TAG = re.compile(rf"</?(?:{'|'.join(TAGS)})(?:\s+[^<>]*)?\s*/?>|<!--.*?(?:-->|$)|<!DOCTYPE\b[^>]*>", re.I | re.S)
CHARREF = re.compile(rf"&(?:#\d{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|(?:{ENTITIES}));")
PATH = re.compile(r"\b[A-Za-z]:\\[^\s]*")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n`]*\n(.*?)(?:^ {0,3}\1[`~]*[ \t]*$|\Z)", re.M | re.S)
PRE = re.compile(r"<(pre|code|script|style|nowiki|syntaxhighlight|source)\b[^>]*>(.*?)(</\1\s*>|\Z)", re.I | re.S)
VERBATIM = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted|alltt|code)\}(.*?)(\\end\{\1\}|\Z)", re.S)
INDENTED = re.compile(r"(?:\A|^[^\S\n]*\n)(?:(?: {4}|\t)[^\S\n]*\S[^\n]*(?:\n|\Z))+", re.M)
INLINE = re.compile(r"(?<!`)`([^`\n]+)`(?!`)")
MATH = re.compile(r"\$\$.+?\$\$|(?<![\\\w$])\$(?=[^$\n]*[\\^_={}])(?!\d+(?:[.,]\d+)? )[^$\n]+\$(?!\w)|\\\[.+?\\\]|\\\(.+?\\\)", re.S)
LATEX = re.compile(rf"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])*\{{|\\(?:{BARE_COMMANDS})(?![A-Za-z])|(?<=[\w)])\\[%&_#$](?!\w*\\)")
WIKI = re.compile(r"\[\[[^\[\]\n]+\]\]|\{\{[^{}\n]+\}\}|^(={2,6})[ \t]*[^=\n]+?[ \t]*\1[ \t]*$|^\{\|.*$|^\|(?:-+[ \t]*$|\}.*$)|'''[^'\n]+'''|(?<![\w'`])''[^'\n]+''(?![\w'])|__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION|NOINDEX|INDEX)__|\[https?://\S+ [^\]\n]+\]", re.M)
WIKI_SIGNS = ("[[", "{{", "''", "==", "{|", "|-", "|}", "__", "[http")
QUOTES = re.compile(r"``[^`'\n]+''")
#: A literal that a text must hold, and the mark it is then searched for.
MARKDOWN = (
    ("](", re.compile(r"!\[[^\]\n]*\]\([^)\n]*\)|(?<!\[)\[[^\[\]\n]+\]\((?!\d+\))[^()\s]+(?:\s+\"[^\"\n]*\")?\)")),
    ("**", re.compile(r"(?<![\w*])\*\*(?=\S)[^*\n]+?(?<=\S)\*\*(?![*\w])")),
    ("__", re.compile(r"(?<![\w.])__(?!init|name|main|file|doc|dict|call|str|repr|len|class|all)(?=\S)[^_\n]+?(?<=\S)__(?![\w(.])")),
    ("~~", re.compile(r"~~(?=\S)[^~\n]+?(?<=\S)~~")),
    ("##", re.compile(r"^ {0,3}#{2,6} +\S", re.M)),
    (">", re.compile(r"^ {0,3}> ?\S", re.M)),
    ("] ", re.compile(r"^[^\n\S]*[-*+] \[[ xX]\] ", re.M)),
    ("\n===", re.compile(r"[^\s=][^\n]*\n={3,}[ \t]*$", re.M)),
    ("\n---", re.compile(r"^(?![|-])[^\n]*\S[^\n]*\n-{3,}[ \t]*$", re.M)),
    ("|\n|", re.compile(r"\|[ \t]*\n\|[ \t:|]*-[ \t:|-]*\|[ \t]*$", re.M)),
    ("*", re.compile(r"(?<![\w*\\])\*(?=[^\s*\d])[^*\n]+?(?<=[^\s*])\*(?![\w*])")),
)
HASH_LINE, STAR_LINE, DASH_LINE = re.compile(r"^# \S", re.M), re.compile(r"^\*{1,4} ?[^\s*]", re.M), re.compile(r"^[-+] \S", re.M)
QUICK = re.compile(r"[<&\\`*_~#\[{|$']|^[=>+-]", re.M)

#: Weights of a word, a word in a link, a tag that sets text and a tag that sets out the page, if no page of the table is labelled.
WEIGHTS = (1.0, -0.5, -0.3, -3.25)
CLASSES = ("word", "link", "text_tag", "page_tag")
TEXT_TAG = re.compile(r"</?(?:h[1-6]|p|li|ul|ol|dl|dt|dd|b|i|u|em|strong|code|pre|sup|sub|td|th|tr|table|thead|tbody|caption|span|br|blockquote|a|img|small|cite|q|kbd|mark)\b", re.I)
LINK, LINK_END = re.compile(r"<a\b", re.I), re.compile(r"</a\b", re.I)
#: Pages that the weights are fitted on, at most.
SAMPLE = 10_000


def kinds(text: str | None) -> list[str]:
    """The kinds of markup in a text, in the order of ``KINDS``."""
    if not text or not QUICK.search(text):
        return []
    found: set[str] = set()

    def blank(kind: str):
        def put(m: re.Match) -> str:
            found.add(kind)
            return "\n"

        return put

    if "```" in text or "~~~" in text:
        text = FENCE.sub(blank("markdown"), text)
    text = VERBATIM.sub(blank("latex"), text)
    text = PRE.sub(blank("html"), text)
    if ":\\" in text:
        text = PATH.sub(" ", text)
    if QUOTES.search(text):
        text = QUOTES.sub(" ", text)
    if "`" in text:
        text = INLINE.sub(blank("markdown"), text)
    if TAG.search(text) or CHARREF.search(text):
        found.add("html")
        text = TAG.sub(" ", text)
    text = INDENTED.sub("\n", text)
    if "$" in text or "\\" in text:
        text, n = MATH.subn(" ", text)
        if n or LATEX.search(text):
            found.add("latex")
    if any(sign in text for sign in WIKI_SIGNS):
        text, n = WIKI.subn(" ", text)
        if n:
            found.add("wiki")
    if any(sign in text and mark.search(text) for sign, mark in MARKDOWN):
        found.add("markdown")
    if not found & {"markdown", "wiki"}:
        hashes, stars, dashes = bool(HASH_LINE.search(text)), bool(STAR_LINE.search(text)), bool(DASH_LINE.search(text))
        if hashes or stars or dashes:
            if not found:
                found.add("wiki" if hashes and stars and not dashes else "markdown")
            elif hashes and not stars:
                found.add("markdown")
    return [k for k in KINDS if k in found]


def content_region(classes: list[str], weights: tuple[float, float, float, float] = WEIGHTS) -> tuple[int, int]:
    """Start and end of the contiguous tokens of maximum score; of each token its class (``CLASSES``)."""
    worth = dict(zip(CLASSES, weights))
    best = here = 0.0
    start = 0
    span = (0, 0)
    for k, c in enumerate(classes):
        if here <= 0:
            here, start = 0.0, k
        here += worth[c]
        if here > best:
            best, span = here, (start, k + 1)
    return span


def fit_weights(pages: Iterable[tuple[list[str], tuple[int, int]]]) -> tuple[float, float, float, float]:
    """Weights from pages (classes of the tokens, content region): log odds of standing inside, scaled to 1 for a word; tags count against."""
    from math import log

    count = {c: [1.0, 1.0] for c in CLASSES}
    for classes, (a, b) in pages:
        for k, c in enumerate(classes):
            count[c][a <= k < b] += 1
    odds = {c: log(inside / outside) for c, (outside, inside) in count.items()}
    scale = odds["word"] if odds["word"] > 0 else 1.0
    return 1.0, odds["link"] / scale, min(-0.1, odds["text_tag"] / scale), min(-1.0, odds["page_tag"] / scale)


HTML_TOKEN = re.compile(r"<[^<>]+>|[^\s<]+|<")
UNSEEN = re.compile(r"(?is)<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)")
LABEL = re.compile(r"(?is)<(main|article)\b[^>]*>(.*)</\1\s*>")


def tokens(text: str) -> tuple[list[re.Match], list[str]]:
    """The words and tags of a page, and their classes."""
    marks, classes, depth = list(HTML_TOKEN.finditer(text)), [], 0
    for m in marks:
        t = m.group()
        if t[0] == "<" and len(t) > 1:
            depth = depth + 1 if LINK.match(t) else max(0, depth - 1) if LINK_END.match(t) else depth
            classes.append("text_tag" if TEXT_TAG.match(t) else "page_tag")
        else:
            classes.append("link" if depth else "word")
    return marks, classes


def weights(documents: DataFrame, sample: int = SAMPLE) -> tuple[float, float, float, float]:
    """The weights fitted on at most ``sample`` pages that say where their content is; the defaults if there are none."""
    pages = []
    for (text,) in documents.where(F.col("text").rlike(r"(?i)<body\b") & F.col("text").rlike(r"(?i)</(?:main|article)\s*>")).select("text").limit(sample).toLocalIterator():
        text = UNSEEN.sub(" ", re.sub(r"(?is)^.*?<body\b[^>]*>|</body\s*>.*$", "", text))
        if label := LABEL.search(text):
            marks, classes = tokens(text)
            inside = [k for k, m in enumerate(marks) if label.start(2) <= m.start() < label.end(2)]
            if inside:
                pages.append((classes, (inside[0], inside[-1] + 1)))
    return fit_weights(pages) if pages else WEIGHTS


def _page_content(text: str, worth: tuple[float, float, float, float]) -> str:
    """The content region of a whole page, grown to the next tag of layout on either side."""
    marks, classes = tokens(text)
    a, b = content_region(classes, worth)
    if a == b:
        return text
    while a and classes[a - 1] != "page_tag":
        a -= 1
    while b < len(marks) and classes[b] != "page_tag":
        b += 1
    return text[marks[a].start() : marks[b - 1].end()]


def _clean_html(text: str, worth: tuple[float, float, float, float] = WEIGHTS) -> str:
    if re.search(r"<body\b", text, re.I):
        body = re.sub(r"(?is)^.*?<body\b[^>]*>|</body\s*>.*$", "", text)
        text = _page_content(UNSEEN.sub(" ", body), worth)
        text = re.sub(r"(?is)<(nav|header|footer|aside|form)\b.*?</\1\s*>", " ", text)
    text = re.sub(r"(?is)<!--.*?(?:-->|$)|<!DOCTYPE[^>]*>|<(script|style|head)\b.*?(?:</\1\s*>|$)", " ", text)
    held: list[str] = []

    def keep(m: re.Match) -> str:
        held.append("```\n" + html.unescape(re.sub(r"(?i)</?code\b[^>]*>", "", m.group(2))).strip("\n") + "\n```")
        return f"\n\n\x00{len(held) - 1}\x00\n\n"

    text = re.sub(r"(?is)<(pre)\b[^>]*>(.*?)(?:</pre\s*>|\Z)", keep, text)
    text = re.sub(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1\s*>", lambda m: "\n\n" + "#" * int(m.group(1)) + " " + m.group(2).strip() + "\n\n", text)
    text = re.sub(r"(?i)<li\b[^>]*>\s*", "\n- ", text)
    text = re.sub(r"(?i)</t[dh]\s*>\s*<t[dh]\b[^>]*>", " | ", text)
    text = re.sub(r"(?i)</?(?:p|div|section|article|ul|ol|table|blockquote|figure|main)\b[^>]*>", "\n\n", text)
    text = re.sub(r"(?i)<br\s*/?>|</?tr\b[^>]*>|<hr\s*/?>", "\n", text)
    text = TAG.sub("", text)
    text = html.unescape(CHARREF.sub(lambda m: html.unescape(m.group()), text)).replace("\xa0", " ")
    return re.sub("\x00(\\d+)\x00", lambda m: held[int(m.group(1))], text)


BRACE = re.compile(r"\\.|[{}]", re.S)
COMMAND = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{")


def _braces(text: str) -> dict[int, int]:
    """The place of each opening brace with that of the one that closes it."""
    pairs, held = {}, []
    for m in BRACE.finditer(text):
        if m.group() == "{":
            held.append(m.start())
        elif m.group() == "}" and held:
            pairs[held.pop()] = m.start()
    return pairs


def _clean_latex(text: str) -> str:
    held: list[str] = []

    def keep(s: str) -> str:
        held.append(s)
        return f"\x01{len(held) - 1}\x01"

    text = VERBATIM.sub(lambda m: "\n\n" + keep("```\n" + m.group(2).strip("\n") + "\n```") + "\n\n", text)
    text = re.sub(r"(?s)\\begin\{(equation|align|gather|displaymath|math|eqnarray)\*?\}(.*?)\\end\{\1\*?\}", lambda m: keep("$$" + m.group(2).strip() + "$$"), text)
    text = MATH.sub(lambda m: keep("$$" + m.group()[2:-2].strip() + "$$" if m.group().startswith("\\") or m.group().startswith("$$") else m.group()), text)
    text = re.sub(r"(?<!\\)%[^\n]*", "", text)
    text = re.sub(r"\\(?:documentclass|usepackage|bibliographystyle|bibliography|newcommand|input|include|pagestyle)(?:\[[^\]]*\])?\{[^}]*\}(?:\{[^}]*\})?|\\maketitle|\\begin\{document\}|\\end\{document\}", "", text)
    for name, mark in (("section", "#"), ("subsection", "##"), ("subsubsection", "###"), ("paragraph", "####"), ("chapter", "#"), ("title", "#")):
        text = re.sub(rf"\\{name}\*?\{{([^{{}}]*)\}}", lambda m, mark=mark: f"\n\n{mark} {m.group(1)}\n\n", text)
    text = re.sub(r"\\item(?:\[([^\]]*)\])?\s*", lambda m: "\n- " + (m.group(1) + " " if m.group(1) else ""), text)
    text = re.sub(r"\\(?:begin|end)\{[^}]*\}(?:\[[^\]]*\]|\{[^}]*\})*", "\n", text)
    text = re.sub(r"[ ~]?\\(?:cite[a-z]*|label)\*?(?:\[[^\]]*\])*\{[^}]*\}", "", text)
    text = re.sub(r"\\(?:ref|eqref|autoref|pageref)\{([^}]*)\}", r"\1", text)
    while COMMAND.search(text):
        ends, out, at = _braces(text), [], 0
        while m := COMMAND.search(text, at):
            end = ends.get(m.end() - 1, -1)
            out.append(text[at : m.start()])
            if end < 0:
                out.append(" ")
                at = m.end()
            else:
                inner = text[m.end() : end]
                out.append(f" ({inner})" if m.group().startswith("\\footnote") else inner)
                at = end + 1
        text = "".join(out) + text[at:]
    text = re.sub(rf"\\(?:{BARE_COMMANDS})(?![A-Za-z])\s?", "", text)
    text = re.sub(r"\\([%&_#$])", r"\1", text).replace("~", " ")
    return re.sub("\x01(\\d+)\x01", lambda m: held[int(m.group(1))], text)


def _clean_wiki(text: str) -> str:
    text = re.sub(r"\[\[(?:Category|Kategorie|Catégorie|Categoría):[^\]\n]*\]\]|__[A-Z]+__", "", text)
    text = re.sub(r"\[\[(?:File|Image|Datei|Fichier|Archivo):[^\]|\n]*(?:\|[^\]|\n]*)*?\|?([^\]|\n]*)\]\]", r"\1", text)
    text = re.sub(r"\[\[(?:[^\]|\n]*\|)?([^\]\n]*)\]\]", r"\1", text)
    n = 1
    while n:
        text, n = re.subn(r"\{\{[^{}]*\}\}", "", text)
    text = re.sub(r"^(={1,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", lambda m: "#" * len(m.group(1)) + " " + m.group(2), text, flags=re.M)
    text = re.sub(r"'{2,5}", "", text)
    text = re.sub(r"^\{\|.*$|^\|[-}].*$", "", text, flags=re.M)
    text = re.sub(r"^[!|][ \t]*(.*)$", lambda m: re.sub(r"\s*(?:!!|\|\|)\s*", " | ", m.group(1)), text, flags=re.M)
    text = re.sub(r"^[*#]+[ \t]*(?=\S)(?![#]* )", "- ", text, flags=re.M) if "#" not in text.split("\n", 1)[0] else re.sub(r"^\*+[ \t]*", "- ", text, flags=re.M)
    text = re.sub(r"^[:;]+[ \t]*", "", text, flags=re.M)
    return re.sub(r"\[https?://\S+ ([^\]\n]+)\]", r"\1", text)


def _clean_markdown(text: str) -> str:
    held: list[str] = []

    def keep(m: re.Match) -> str:
        held.append("```\n" + m.group(2).rstrip("\n") + "\n```")
        return f"\x02{len(held) - 1}\x02"

    text = FENCE.sub(keep, text)
    text = re.sub(r"^([^\n]+)\n(=+|-{3,})[ \t]*$", lambda m: ("# " if m.group(2)[0] == "=" else "## ") + m.group(1), text, flags=re.M)
    text = re.sub(r"^ {0,3}(#{1,6}) +(.*?)[ \t]*#*$", r"\1 \2", text, flags=re.M)
    text = re.sub(r"!\[([^\]\n]*)\]\([^)\n]*\)", r"\1", text)
    text = re.sub(r"(?<!\[)\[([^\[\]\n]+)\]\([^()\n]+\)", r"\1", text)
    text = re.sub(r"\*\*([^*\n]+)\*\*|(?<!\w)__([^_\n]+)__(?!\w)|~~([^~\n]+)~~", lambda m: m.group(1) or m.group(2) or m.group(3), text)
    text = re.sub(r"(?<!\w)[*_](?=\S)([^*_\n]+?)(?<=\S)[*_](?!\w)", r"\1", text)
    text = INLINE.sub(r"\1", text)
    text = re.sub(r"^[ \t]*[-*+] (?:\[[ xX]\] )?", "- ", text, flags=re.M)
    text = re.sub(r"^ {0,3}> ?", "", text, flags=re.M)
    text = re.sub(r"^\|[ \t:|-]+\|[ \t]*\n?", "", text, flags=re.M)
    text = re.sub(r"^\|(.*)\|[ \t]*$", lambda m: " | ".join(c.strip() for c in m.group(1).split("|")), text, flags=re.M)
    return re.sub("\x02(\\d+)\x02", lambda m: held[int(m.group(1))], text)


def clean(text: str | None, worth: tuple[float, float, float, float] = WEIGHTS) -> str | None:
    """Text without marks: headings as '# ', list items as '- ', code between ``` lines, formulas between $ signs.

    A text without markup comes back as it is; null stays null.
    """
    if text is None:
        return None
    found = kinds(text)
    if not found:
        return text
    for kind, how in (("latex", _clean_latex), ("html", _clean_html), ("wiki", _clean_wiki), ("markdown", _clean_markdown)):
        if kind in found:
            text = how(text, worth) if kind == "html" else how(text)
    text = re.sub(r"[ \t]+\n", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _run(with_text: bool, worth: tuple[float, float, float, float] = WEIGHTS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, kind, out = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = kinds(text)
                if with_text and found:
                    row.append(k), kind.append(found), out.append(clean(text, worth))
                elif found:
                    row += [k] * len(found)
                    kind += found
            cols = [batch.column(0).take(pa.array(row, pa.int64()))]
            if with_text:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(kind, pa.list_(pa.string())), pa.array(out, pa.string())], ["doc_id", "markups", "clean_text"])
            else:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(kind, pa.string())], ["doc_id", "markup"])

    return run


def _marked(documents: DataFrame) -> DataFrame:
    """The texts that can hold marks at all; the rest never leaves the JVM."""
    return documents.where(F.col("text").rlike(r"[<&\\`*_~#\[{|$']|(?m)^[=>+-]")).select("doc_id", "text")


def found(documents: DataFrame) -> DataFrame:
    """doc_id, markup: a row per document and kind. Null, empty and plain texts give none; a repeated row counts once."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return _marked(documents).mapInArrow(_run(False), f"doc_id {kind}, markup string").dropDuplicates()


def cleaned(documents: DataFrame) -> DataFrame:
    """doc_id, markups, clean_text of the documents with markup; all others are clean as they stand."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return _marked(documents).mapInArrow(_run(True, weights(documents)), f"doc_id {kind}, markups array<string>, clean_text string")
