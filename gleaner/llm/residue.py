"""Problem 5: template residue, filler and error-page text.

Labelled exemplars (the public default texts of publishing systems, servers, proxies and browsers in nine languages, by
kind, and slots of common template languages) are kept in an inverted index from token to exemplar. A field is cut into
passage windows (its sentences and lines; a title as a whole). Each window fetches the exemplars that share a token with it;
it is residue if it covers at least ``COVER`` of the weight of one exemplar and the exemplars of that kind together contain
at least ``CONTAINMENT`` of the window's own TF-IDF weight. A slot is a token of its own, named by the shape of its delimiters
and of what lies between them (``{{title}}`` and ``{{ post.name }}`` have one shape), and is looked up in the same index as a
window of its own, unless it stands in quotation marks or the words around it are about templates (exemplars labelled as
content). Document frequencies are counted over all fields of the whole table.

The table is read twice: once for the frequencies (only tokens of the exemplars leave the map side), once for the windows.
Windows are scored only in fields that hold an anchor, a slot delimiter or a token of a prefix. The prefix filter loses
nothing: the anchors of an exemplar are its heaviest tokens down to where the rest weighs less than ``COVER`` of it, so a window
without any of them covers less than ``COVER`` of that exemplar and cannot match it.

Defined results: null, empty and blank fields and bare names give no row; repeated rows each give theirs; texts of any
length are scored whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.tables import spread

CONTAINMENT, COVER = 0.8, 0.5

# Labelled exemplars of residue by kind: default texts of common systems.
RESIDUE: dict[str, list[str]] = {
    "lorem": [
        "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum",
    ],
    "filler": [
        "Your text here", "Your text goes here", "Add your text here", "Click to add text", "Click here to edit", "Enter your text here", "Insert your title here", "Title goes here", "Headline goes here", "Body text goes here", "Description goes here", "Start typing here",
        "Hello world", "Welcome to WordPress", "This is your first post", "Edit or delete it, then start writing", "This is an example page", "Sample page", "Sample post", "Sample text", "Placeholder text", "Placeholder", "Untitled document", "Untitled", "New post", "Copy of post", "Text to come", "Coming soon",
        "Draft, do not publish", "Article title", "No title", "Hier steht Ihr Text", "Hier steht später ein Text", "Blindtext", "Votre texte ici", "Ajoutez votre texte ici", "Texte à venir", "Escriba aquí su texto", "Su texto aquí", "Texto de ejemplo", "Escreva aqui o seu texto", "Seu texto aqui", "Texto de exemplo",
        "Inserisci qui il tuo testo", "Il tuo testo qui", "Testo di esempio", "Здесь будет ваш текст", "Введите текст", "Пример текста", "在此输入文字", "单击此处添加文本", "示例文字", "ここに文章を入力してください", "テキストを入力してください", "ダミーテキスト",
    ],
    "values": ["null", "undefined", "None", "undefined undefined"],
    "scripts": [
        "You need to enable JavaScript to run this app", "This site requires JavaScript", "JavaScript is required to view this page", "JavaScript is disabled in your browser", "JavaScript seems to be disabled in your browser", "JavaScript is turned off", "For the best experience turn on JavaScript in your browser",
        "Please enable JavaScript and cookies to continue", "Please turn on JavaScript and reload the page", "Enable cookies and reload", "Scripts must be enabled to use this site", "Your browser does not support scripts", "Your browser blocks scripts", "This app cannot start without scripts", "Switch it on to view this article", "Turn it on to see the content",
        "Bitte aktivieren Sie JavaScript, um diese Seite zu nutzen", "Veuillez activer JavaScript pour afficher cette page", "Active JavaScript para ver esta página", "Ative o JavaScript para usar este site", "Attiva JavaScript per usare questo sito", "Включите JavaScript, чтобы открыть эту страницу", "请启用 JavaScript 后再访问", "请启用 JavaScript 并刷新页面", "このページを見るには JavaScript を有効にしてください",
    ],
    "missing": [
        "Not Found", "Page not found", "Oops! That page can't be found", "The page you requested could not be found", "The page you are looking for was moved or removed", "The page you were looking for doesn't exist", "The requested URL was not found on this server", "Nothing was found at this location", "This page does not exist",
        "The resource you are looking for might have been removed, had its name changed, or is temporarily unavailable", "The address was not found on this server",
        "Seite nicht gefunden", "Die Seite wurde nicht gefunden", "Page introuvable", "La page est introuvable", "La page demandée a été déplacée ou supprimée", "Página no encontrada", "No se encontró la página", "Página não encontrada", "A página não foi encontrada", "Pagina non trovata", "La pagina non è stata trovata",
        "Страница не найдена", "Такой страницы не существует", "页面不存在", "找不到页面", "您访问的页面不存在", "ページが見つかりません", "お探しのページは見つかりません",
    ],
    "failure": [
        "Error", "Internal Server Error", "The server encountered an internal error and was unable to complete your request", "Bad Gateway", "Gateway Timeout", "Service Unavailable", "Service Temporarily Unavailable", "Error Backend fetch failed", "Guru Meditation", "upstream connect error or disconnect/reset before headers", "upstream connect error, reset reason", "no healthy upstream",
        "Traceback (most recent call last): File line in", "KeyError", "File views.py line in render", "Warning: Undefined variable in index.php on line", "Notice: Undefined index in post.php on line", "Fatal error: Uncaught exception in index.php on line", "Error establishing a database connection", "There has been a critical error on this website",
        "Something went wrong", "Something went wrong on our side", "Sorry, something went wrong on our end, please try again later", "An unexpected error occurred", "An error occurred while processing your request", "Whoops, looks like something went wrong", "The incident number is", "Reference number", "Error code", "ref", "Request ID", "Request timed out", "The connection timed out", "The session timed out",
        "Too Many Requests", "Too many requests, please slow down", "Retry after a few seconds", "Try again later",
        "Es ist ein Fehler aufgetreten", "Kennung des Fehlers", "Fehler Nummer", "Une erreur est survenue", "Une erreur s'est produite", "Référence de l'erreur", "Se ha producido un error", "Código de error", "Ocorreu um erro", "Código do erro", "Si è verificato un errore", "Codice errore", "Произошла ошибка", "Код ошибки", "出现错误", "发生错误", "错误编号", "エラーが発生しました", "番号",
    ],
    "blocked": [
        "Access denied", "Forbidden", "Unauthorized", "You don't have permission to access this resource", "Just a moment", "Attention Required! Cloudflare", "Attention required", "Sorry, you have been blocked", "Checking your browser before accessing", "Checking if the site connection is secure", "Verify you are human by completing the action below", "Click the box below to show us you are not a robot", "Check the box to prove that you are human",
        "I'm not a robot", "Are you a robot", "We noticed something unusual", "Our systems have detected unusual traffic from your computer network", "Unusual traffic from your network", "We have paused access to this page", "Sign in to continue", "Please log in to continue reading", "Your session has expired", "Please log in", "Subscribe to continue reading", "This content is not available in your region",
        "Zugriff verweigert", "Accès refusé", "Acceso denegado", "Acesso negado", "Accesso negato", "Доступ запрещён", "访问被拒绝", "アクセスが拒否されました",
    ],
    "slot": [
        "{{ title }}", "{{ x | f: 9 }}", "{{ NAME }}", "${{ env.name }}", "{% block %}", "${user.name}", "${NAME}", "#{item.name}", "<%= page.title %>", "<?= $title ?>", "<?php echo $title; ?>", "%%TITLE%%", "%%title%%", "%TITLE%", "$$NAME$$", "@@name@@", "@@NAME@@", "__NAME__", "[[name]]", "[[First name]]", "{name}", "{0}", "<NAME>",
        "[Insert title here]", "[Your text here]", "[Placeholder: text]", "[Add image]", "[Enter name]", "[TODO: write]", "[TBD]", "XXXX", "TKTK", "NaN", "[object Object]", "undefined undefined",
    ],
}

# Labelled exemplars of real content about templates: what is said around a slot that is quoted as a topic.
CONTENT = [
    "the template engine replaces a placeholder such as", "a template such as", "the parser treats them alike", "the parser reads both as the same token", "the syntax stands for a variable", "fills variables in scripts", "expands variables in shell scripts", "how to escape braces in a template",
    "keeps double braces unescaped", "braces in prompts", "writes the placeholder as", "the literal string", "the regular expression matches",
]

_DELIMITERS = [("${{", "}}"), ("{{", "}}"), ("{%", "%}"), ("${", "}"), ("#{", "}"), ("<%", "%>"), ("<?", "?>"), ("%%", "%%"), ("$$", "$$"), ("@@", "@@"), ("[[", "]]")]
_SLOT = re.compile(
    "|".join(rf"{re.escape(a)}[^\r\n{re.escape(a[-1] + b[0])}]{{0,80}}{re.escape(b)}" for a, b in _DELIMITERS)
    + r"|(?<![^\W_])__[A-Za-z]\w{2,40}__(?![^\W_])|%[A-Za-z_]{3,40}%|(?<![{$#\w])\{[\w.]{1,40}\}(?!\})|<[A-Za-z_]{4,30}>|\[[A-Za-z][^\[\]\r\n]{0,80}\]"
    r"|(?<![A-Za-z])(?:X{4,}|(?:TK){2,}|NaN|undefined undefined)(?![A-Za-z])"
)
_SLOT_SIGNS = ("{", "[", "<", "%", "&", "$$", "@@", "__", "XXXX", "TKTK", "NaN", "undefined u")  # one is in every slot, or in its escaped form

_CJK = "぀-ヿ㐀-鿿々ー"
_TOKEN = re.compile(rf"[{_CJK}]+|[^\W\d_{_CJK}]+(?:['’][^\W\d_{_CJK}]+)*")
_PLAIN = re.compile(rf"[^\W\d_{_CJK}]+")
_CJK_RUN = re.compile(rf"[{_CJK}]+")
_HOST = re.compile(r"(?<![\w.])(?:[\w-]+\.)+[a-z]{2,10}(?!\w|\.\w)", re.I)
_PATH = re.compile(r"(?<![\w/])/[\w./%-]+")
_CODE = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{3,40}\b|\b\d+\b", re.I)
_NOISE = re.compile(r"\d|/|\w\.\w")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|(?<=[。！？])\s*|[\r\n]+")
_QUOTED = re.compile(r"['‘’\"“”„«»`‹›「」『』]$"), re.compile(r"^['‘’\"“”«»`‹›「」『』]")


def tokens(text: str) -> list[str]:
    """Words in lower case, runs of CJK as pairs of characters; hosts, paths, numbers and codes weigh nothing and go."""
    if _NOISE.search(text):
        text = _CODE.sub(" ", _PATH.sub(" ", _HOST.sub(lambda m: m.group(0) if m.group(0)[-3:] in ("php", ".py") else " ", text)))
    out = []
    for t in _TOKEN.findall(text.lower()):
        if "぀" <= t[0] <= "鿿":
            out += [t[i : i + 2] for i in range(len(t) - 1)] or [t]
        else:
            out.append(t.replace("’", "'"))
    return out


def plain_tokens(text: str) -> list[str]:
    """A superset of the parts of :func:`tokens`, cheaper: words cut at apostrophes too, pairs and single characters of CJK."""
    low = text.lower()
    out = _PLAIN.findall(low)
    if not low.isascii():
        for run in _CJK_RUN.findall(low):
            out += [run[i : i + 2] for i in range(len(run) - 1)] or [run]
    return out


class Vocabulary:
    """Finds the members of a fixed set of plain tokens in many texts; what a stretch between white space holds is looked up once."""

    def __init__(self, members: frozenset[str], keep: int = 400_000):
        self.members, self.keep = members, keep
        self.empty: set[str] = set()  # stretches that hold no member
        self.found: dict[str, frozenset[str]] = {}

    def look(self, text: str) -> set[str]:
        """The members in the text."""
        rest = set(text.split())
        rest -= self.empty
        out: set[str] = set()
        for x in rest:
            hit = self.found.get(x)
            if hit is None:
                hit = self.members.intersection(plain_tokens(x))
                if len(x) <= 40:
                    if len(self.empty) + len(self.found) > self.keep:
                        self.empty, self.found = set(), {}
                    if hit:
                        self.found[x] = hit
                    else:
                        self.empty.add(x)
            out |= hit
        return out


def _plain_part(token: str) -> str:
    return max(token.split("'"), key=len)


def slot_shape(lexeme: str) -> str:
    """The token of a slot: its delimiters around the class of what lies between them."""
    if lexeme[0] == "[" and lexeme[1] != "[":
        return "[" + re.split(r"\W", lexeme[1:], maxsplit=1)[0].lower() + "]"
    if lexeme[0].isalpha():
        return "~" + re.sub(r"^X+$", "XXXX", re.sub(r"^(?:TK)+$", "TKTK", lexeme))
    opened = re.match(r"[^\w\s]+|__", lexeme).group(0)
    closed = re.search(r"(?:[^\w\s]+|__)$", lexeme).group(0)
    if opened[:2] == "<?":
        opened, closed = "<?", "?>"
    inner = lexeme[len(opened) : len(lexeme) - len(closed)].strip(" =-")
    kind = "9" if inner.isdigit() else "w" if re.fullmatch(r"[a-z]+(?:[_.][a-z]+)*", inner) else "W" if re.fullmatch(r"[A-Z]+(?:_[A-Z]+)*", inner) else "e"
    if opened.startswith(("{{", "${", "#{", "<%", "<?", "{%", "[[")):  # nobody writes these pairs in prose, whatever they hold
        return opened.rstrip("=-") + "·" + closed
    return opened + kind + closed


def may_slot(text: str) -> bool:
    """Does the text hold what every slot holds?"""
    return any(sign in text for sign in _SLOT_SIGNS)


def slots(text: str) -> Iterator[tuple[str, int, int]]:
    """``(shape, begin, end)`` of every slot-like lexeme."""
    for m in _SLOT.finditer(text):
        yield slot_shape(m.group(0)), m.start(), m.end()


class ExemplarIndex:
    """The inverted index over the labelled exemplars and the scoring of windows against it."""

    def __init__(self, weights: dict[str, float], residue: dict[str, list[str]] = RESIDUE, content: list[str] = CONTENT, containment: float = CONTAINMENT, cover: float = COVER):
        self.containment, self.cover = containment, cover
        self.default = sum(weights.values()) / len(weights) if weights else 1.0
        self.shapes = {shape for x in residue.get("slot", []) for shape, _, _ in slots(x)}
        texts = [(kind, set(tokens(x)), len(tokens(x))) for kind, xs in residue.items() if kind != "slot" for x in xs]
        self.kinds = [kind for kind, _, _ in texts]
        sets = [s for _, s, _ in texts]
        self.content = [set(tokens(x)) for x in content]
        self.weights = {t: weights.get(t, self.default) for s in [*sets, *self.content] for t in s}
        self.mass = [sum(self.weights[t] for t in s) for s in sets]
        for i, kind in enumerate(self.kinds):
            if kind == "lorem":  # filler is drawn from its words at will
                self.mass[i] = min(self.mass[i], 4 * self.default)
        self.postings: dict[str, list[int]] = {}
        for i, s in enumerate(sets):
            for t in s:
                self.postings.setdefault(t, []).append(i)
        self.of_kind: dict[str, set[str]] = {}
        for kind, s in zip(self.kinds, sets):
            self.of_kind.setdefault(kind, set()).update(s)
        self.lengths = sorted({n for _, _, n in texts if n >= 4})
        self.long = [n >= 4 for _, _, n in texts]
        self.anchors: frozenset[str] = frozenset()
        prefix: set[str] = set()
        for s, mass in zip(sets, self.mass):
            rest = sum(self.weights[t] for t in s)
            for t in sorted(s, key=lambda t: (-self.weights[t], t)):
                if rest < cover * mass:
                    break
                prefix.add(_plain_part(t))
                rest -= self.weights[t]
        self.anchors = frozenset(prefix)
        self.prefixes = Vocabulary(self.anchors)

    def anchored(self, text: str) -> bool:
        """May the text hold residue: a slot's delimiter, or a token of some exemplar's prefix?"""
        return may_slot(text) or bool(self.prefixes.look(text))

    def best(self, words: Iterable[str]) -> tuple[float, float]:
        """Largest containment of the window in one kind (given the cover of one exemplar of it), and the largest cover of any exemplar of four words or more."""
        distinct = dict.fromkeys(words)
        if not distinct:
            return 0.0, 0.0
        hit: dict[int, float] = {}
        for w in distinct:
            for i in self.postings.get(w, ()):
                hit[i] = hit.get(i, 0.0) + self.weights[w]
        covered = {i: m / self.mass[i] for i, m in hit.items()}
        near = {self.kinds[i] for i, c in covered.items() if c >= self.cover}
        longest = max((c for i, c in covered.items() if self.long[i]), default=0.0)
        if not near:
            return 0.0, longest
        total = sum(self.weights.get(w, self.default) for w in distinct)
        contained = max(sum(self.weights[w] for w in distinct if w in self.of_kind[k]) / total for k in near)
        return contained, longest

    def has_slot(self, window: str) -> bool:
        """Does the window hold a slot of a labelled shape that is not mentioned as a topic?"""
        found = [(a, b) for shape, a, b in slots(window) if shape in self.shapes]
        if not found:
            return False
        rest = set(tokens(_SLOT.sub(" ", window)))
        if any(sum(self.weights[t] for t in c & rest) >= self.cover * sum(self.weights[t] for t in c) for c in self.content):
            return False
        return not all(_QUOTED[0].search(window[:a]) and _QUOTED[1].search(window[b:]) for a, b in found)

    def is_residue(self, text: str, title: bool) -> bool:
        """Does any window of the field hold residue?"""
        if "&" in text:
            text = html.unescape(text)
        slotted = may_slot(text)
        for window in [text] if title else _SPLIT.split(text):
            if not window or not window.strip():
                continue
            if slotted and self.has_slot(window):
                return True
            if not self.prefixes.look(window):
                continue
            words = tokens(window)
            contained, covered = self.best(words)
            if contained >= self.containment:
                return True
            if not title and len(words) > 8 and covered >= 0.95:
                # machine messages often end without a stop: then the next sentence is glued to them
                for n in self.lengths:
                    if n < len(words) and any(c[0] >= 0.95 and c[1] >= 0.95 for c in (self.best(words[:n]), self.best(words[-n:]))):
                        return True
        return False

    def holds(self, text: str | None, title: bool) -> bool:
        """The decision for a field, prefix filter first."""
        return bool(text) and self.anchored(text) and self.is_residue(text, title)


VOCABULARY = frozenset(t for x in [*(x for xs in RESIDUE.values() for x in xs), *CONTENT] for t in tokens(x))
_PARTS = {t: _plain_part(t) for t in VOCABULARY}
_PART_SET = frozenset(_PARTS.values())
EVERY = "\x00"  # a token that every field is given: its count is the number of fields


def vocabulary_parts() -> list[str]:
    """The plain tokens that :func:`count_fields` counts."""
    return sorted(_PART_SET)


def count_fields(texts: Iterable[str | None], vocabulary: Vocabulary | None = None) -> Counter:
    """Number of fields that hold each token of the exemplars."""
    out: Counter = Counter()
    vocabulary = vocabulary or Vocabulary(_PART_SET)
    for x in texts:
        if x and not x.isspace():
            out[EVERY] += 1
            out.update(vocabulary.look(x))
    return out


def weights_of(counts: dict[str, int]) -> dict[str, float]:
    """Inverse document frequencies from the counts of :func:`count_fields`."""
    total = counts.get(EVERY, 0)
    return {t: math.log((total + 1) / (counts.get(p, 0) + 1)) + 1 for t, p in _PARTS.items()} if total else {}


def exemplar_weights(items: DataFrame, fields: tuple[str, ...] = ("title", "summary")) -> dict[str, float]:
    """Inverse document frequency of the exemplars' tokens over all fields of all rows (bounded by the exemplars, so it is collected)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        vocabulary = Vocabulary(_PART_SET)
        for pdf in batches:
            for f in fields:
                total.update(count_fields(pdf[f].array, vocabulary))
        if total:
            yield pd.DataFrame({"token": list(total.keys()), "df": list(total.values())})

    counts = spread(items.select(*fields)).mapInPandas(count, "token string, df bigint").groupBy("token").agg(F.sum("df").alias("df"))
    return weights_of({r["token"]: r["df"] for r in counts.collect()})


def find_residue(items: DataFrame, weights: dict[str, float] | None = None, key: str = "item_id") -> DataFrame:
    """``key, field`` of every field ('title' or 'summary') that holds residue. ``weights``: see :func:`exemplar_weights`."""
    index = ExemplarIndex(exemplar_weights(items) if weights is None else weights)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, fields = [], []
            for field in ("title", "summary"):
                for k, text in zip(pdf["k"].array, pdf[field].array):
                    if text and index.holds(text, field == "title"):
                        keys.append(k)
                        fields.append(field)
            yield pd.DataFrame({"k": pd.Series(keys, dtype="int64"), "field": pd.Series(fields, dtype="object")})

    rows = items.select(F.col(key).cast("bigint").alias("k"), "title", "summary").filter("k is not null")
    return spread(rows).mapInPandas(scan, "k bigint, field string").select(F.col("k").alias(key), "field")
