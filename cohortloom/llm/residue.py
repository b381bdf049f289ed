"""Template residue, filler, error pages and script notices in texts.

Texts are cut into statements and each distinct statement is scored once by a regularised linear classifier on
hashed n-grams with length and title features. Its labels are weak: response-status lines and phrase rules vote on every
distinct statement; the votes are no feature. The first fit takes a bounded sample; where there are more statements, all of
them go on teaching it where they lie. A long statement is judged by its pieces of bounded length, all of them, so that no
length hides residue. Everything is scored, and what a rule speaks for is residue whatever the classifier says.
"""

from __future__ import annotations

import re
import re._constants as _sre
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from cohortloom.session import materialise

BITS = 18
#: Bound of the sample of the first fit: distinct statements in hash order.
MAX_SAMPLE = 150_000
#: A statement is residue from this probability on.
MIN_PROBABILITY = 0.7
#: Pieces of so many tokens, at every position, are scored beside a statement, or instead of it where it is longer than the largest.
PIECES = (8, 20)
#: Most rounds in which all statements go on teaching the classifier, and the margin from which one without a vote does.
ROUNDS, NEAR = 8, -4.0
#: A share of the sources ("hosts") is held out to validate the classifier.
HELD_OUT = 0.25

_FIELD = r"[A-Za-z][A-Za-z0-9]*(?:[_ .-][A-Za-z0-9]+){0,3}"
_NAMES = r"[A-Za-z][A-Za-z0-9]*(?:[_ .-][A-Za-z0-9]+){1,3}"
# Fixed phrase rules. Placeholders: an unfilled field name inside the marks of a template language, or an instruction to fill it.
_MARKED = [
    rf"\{{\{{\s*{_FIELD}\s*\}}\}}",
    rf"\$\{{\s*{_FIELD}\s*\}}",
    rf"\{{%\s*{_FIELD}\s*%\}}",
    rf"<%=?\s*{_FIELD}\s*%>",
    rf"%\({_FIELD}\)[sdf]",
    rf"@@?\s*{_FIELD}\s*@@?(?!\w)",
    rf"#{_FIELD}#",
    rf"<<\s*{_FIELD}\s*>>",
    rf"&lt;\s*{_FIELD}\s*&gt;",
    rf"<\s*{_NAMES}\s*>",
    r"<(?-i:[A-Z]{3,})>",
    r"__[A-Za-z]+(?:_[A-Za-z]+)*__",
    rf"\[\[\s*(?:todo|tbd|fixme)?\s*:?\s*{_FIELD}\s*\]\]",
    r"\[(?-i:[A-Z]{3,}(?:[_ ][A-Z]+)*)\]",
    rf"[\[<({{]\s*(?:insert|enter|type|add|fill in|your|select|choose)\s+{_FIELD}(?:\s+here)?\s*[\])>}}]",
    rf"[\[<({{]\s*{_FIELD}\s+(?:goes|to go|comes) here\s*[\])>}}]",
    rf"~\s*{_FIELD}\s*~",
    r"\(auto ?text not found\)",
    rf"(?<![\w$%{{])\{{{_FIELD}\}}",
]
_INSTRUCTION = [
    r"\b(?:xxx+|todo|tbd|tbc|fixme)\s*:",
    r"^\W*(?:please )?(?:insert|enter|fill in|type|write|dictate|describe|add|put|paste|state|list)\b.{0,60}\b(?:here|below|above|in this field|of the (?:text|report|letter|note|section|document|record|file|template|page))\W*$",
]
_FILLER = [
    r"\blorem\b|\bipsum\b|\bdolor sit amet\b",
    r"(?:\b(?:lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|do|eiusmod|tempor|incididunt|ut|labore|et|dolore|magna|aliqua|enim|ad|minim|veniam|quis|nostrud)\b\W*){5,}",
    r"\b(?:filler|dummy|placeholder|mock|stub|demo|default|blank|boilerplate|example|sample|some|test)\s+(?:report |page |body )?(?:line|text|content|paragraph|wording|narrative|body|sentence|document|copy|entry|message|title|heading|string)\b",
    r"\b(?:is|as|this) (?:only )?an? (?:placeholder|test (?:page|document|message)|dummy|filler)\b|\bplaceholder (?:for|until)\b|\bwill be replaced by\b",
    r"\byour text here\b|\b(?:text|content) (?:goes|comes) here\b|\bcoming soon\b|\bunder construction\b|\bnothing to see here\b",
    r"\b(?:x{4,}|X{4,})\b(?:\W+\w*x{3,}\b)+|^\W*(?:x{3,}\W*)+\W*\d*\W*$",
    r"\b([A-Za-z]{2,})\b(?:\W+\1\b){2,}",
    r"\b(?:asdf|qwer(?:ty)?|foo bar|blah blah|abc abc|hjkl)\b",
    r"^\W*(?:tbd|tba|tbc|todo|n/a|none|null|nan|undefined)(?:\W+(?:tbd|tba|tbc|todo|n/a|none|null|nan|undefined))+\W*\d*\W*$",
]
_WHAT = r"(?:page|site|website|document|report|record|study|file|address|link|server|host|service|request|store|archive|gateway|view|viewer|session|token|database|resource|url|application|app|system|portal|connection|image|content)"
_STATUS = [
    r"^\W*(?:<\w+>\s*)?(?:https?(?:/\d\.\d)?|status|error|fatal|oops|sorry|unavailable|warning|server error|request failed|notice|bad gateway)?\W*\b[45]\d\d\b\W*(?:-|–|:|\.|,|\(|bad|not|forbidden|unauthori[sz]ed|internal|service|gateway|too|request|the|this|you|an?|no|$)",
    r"^\W*(?:<\w+>\s*)?(?:http|status|http status|http error|error code|error|server error|bad response)\b\W*(?:code\W*)?[1-5]\d\d\b",
    r"^\W*(?:<\w+>\s*)?(?:oops|sorry|fatal|unavailable|request failed|warning: load failed|error|warning|exception|failure)\b\W*(?:$|[-–:.!])",
]
_ERROR = [
    rf"\b{_WHAT}\b[^.]{{0,40}}\b(?:could not|cannot|can't|can not|failed to|was unable to|is unable to|did not) (?:be )?(?:found|load|loaded|displayed|shown|opened|open|reached|rendered|render|processed|answer|respond|connect|start)\b",
    rf"\b{_WHAT}\b[^.]{{0,30}}\b(?:timed out|does not exist|no longer exists|has expired|is no longer valid|was moved or deleted|has been (?:moved|removed|deleted)|refused the request|is locked|was not found|not found|is unavailable|is not available|closed the connection|refused|is down|is offline|is busy|is overloaded|crashed)\b",
    r"\b(?:error|problem|failure) (?:establishing|connecting|loading|opening)\b|\btechnical (?:difficulties|problems|issues)\b",
    r"\b(?:temporarily|currently) (?:unavailable|down|offline|out of service)\b|\bdown for maintenance\b|\bscheduled maintenance\b|\bdid not (?:answer|respond) in time\b",
    r"\bno route to\b|\bupstream\b[^.]{0,30}\b(?:timed out|closed|refused)\b|\b(?:bad|gateway) (?:gateway|timeout|request)\b|\bconnection (?:was |has been )?(?:reset|refused|lost|timed out|closed)\b",
    rf"\b(?:unexpected|unhandled|internal|unknown|fatal|server) (?:exception|error)\b[^.]{{0,60}}\b(?:{_WHAT}|building|rendering|raised|occurred)\b|^\W*(?:internal|server|unknown|unexpected) error\b|\ban error (?:has )?occurred\b|\bsomething went wrong\b",
    r"\byou are not (?:authori[sz]ed|allowed|permitted) to\b|\bdo not have (?:the )?(?:rights|permission|access) to (?:open|view|see|access)\b|^\W*access (?:is |was )?denied\W*$|^\W*(?:permission denied|forbidden|unauthori[sz]ed|not found|page not found|file not found)\W*$",
    r"\btoo many requests\b|\bretry in \d+ seconds\b|\bwait \d+ seconds before\b|^\W*(?:please )?(?:try|come back|check back) (?:again )?(?:later|soon|in a few minutes)\W*$|\btry again later\b",
    r"\b(?:login token|session|password|account) (?:is no longer valid|has (?:expired|been locked)|expired\W*$|is locked)|\b(?:sign|log) in (?:again|to (?:continue|view|see|read|open))\b|\byou (?:must|need to|have to) (?:be logged in|log in|sign in)\b",
    r"\bcontact the (?:help desk|administrator|site owner|webmaster)\b|^\W*(?:request id|trace|session|reference|incident|error id|ticket|ray id)\W+(?=[0-9a-f]*\d)[0-9a-f]{6,}\W*$",
    r"^\W*traceback\b|\b(?-i:[A-Z]\w*(?:Exception|Error))\b|\b(?:exception|error)\b\s*:\s*\w|\bkey not found\b|\bat \w+\.\w+ \(\w+:\d+\)|\bjava\.(?:io|lang|util)\b|\bnull ?pointer\b|\bstack trace\b|\bsegmentation fault\b|\bsyntax error\b|\bundefined (?:index|variable|method)\b|\berr_[a-z_]+\b",
    r"\bseite\b[^.]{0,30}\bnicht (?:gefunden|verfügbar|geladen)\b|\bwenden sie sich an den (?:betreiber|administrator)\b|\b(?:ein|interner) fehler (?:ist )?aufgetreten\b|\bzugriff verweigert\b|\berreur est survenue\b|\bpage\b[^.]{0,20}\b(?:introuvable|indisponible)\b|\bacc[eè]s refus[eé]\b|\bp[aá]gina\b[^.]{0,30}\bno (?:se )?(?:encontr|existe|est[aá] disponible)|\bse ha producido un error\b|\bno se pudo (?:cargar|abrir|encontrar)\b|\bacceso denegado\b|\bsi è verificato un errore\b",
]
_SCRIPT = [
    r"\b(?:enable|activate|allow|permit|turn on|switch on|needs?|requires?|requiring)\b[^.]{0,30}\b(?:javascript|js|scripts?|scripting|script support|active content|cookies)\b(?! for (?!the|this))(?=[^.]*\b(?:page|site|report|app|view|browser|reload|refresh|load|continue|open|display|waveform|record|list)\b|\W*(?:</?\w+>)?\W*$)",
    r"\bbrowser (?:needs|requires|must)\b[^.]{0,30}\bscript|\bbrowser is (?:not supported|out of date|outdated)\b|\bnoscript\b",
    r"\b(?:javascript|js|scripts?|cookies)\b[^.]{0,12}\b(?:is|are|must|has|have)\b[^.]{0,12}\b(?:disabled|blocked|off|switched on|enabled|active|turned on|required)\b",
    r"\bscript blocker\b|\bdoes not (?:run|support) (?:scripts|javascript)\b|\bpermit active content\b|\b(?:viewer|page|site|app) needs scripting\b",
    r"\b(?:checking|verifying) (?:your|that you|if the site)\b|\bverify (?:that )?you are (?:a )?human\b|\bcaptcha\b|^\W*loading\b[^.]{0,30}(?:\.\.\.|…)|^\W*(?:still )?loading\W*$|^\W*please wait\W*$|\bplease wait while\b|\bis (?:still )?loading\b|\brequires it in order to load\b|\bredirect(?:ed|ing) (?:to|you|shortly)\b",
    r"\b(?:aktivieren sie|active|activez|activer|habilite|attivare|attiva|schalten sie)\b[^.]{0,12}\bjavascript\b",
]
_compiled = lambda patterns: [re.compile(x, re.I) for x in patterns]
#: Rules of which every match has one of these marks, and the others.
MARKS = frozenset("{$<%@#&[(~_")
MARKED, PLAIN = _compiled(_MARKED), _compiled((*_INSTRUCTION, *_FILLER, *_STATUS, *_ERROR, *_SCRIPT))
RULES = [*MARKED, *PLAIN]


def _cues(parsed: Sequence) -> frozenset[str] | None:
    """Small letters and signs of which every ASCII match of a parsed pattern has one in it, if any such are known."""
    known, run = [], ""
    for op, arg in [*parsed, (None, None)]:
        if op is _sre.LITERAL:
            run += chr(arg).lower()
            continue
        if run:
            known.append(frozenset((run,)))
        run = ""
        if op is _sre.SUBPATTERN:
            known.append(_cues(arg[-1]))
        elif op in (_sre.MAX_REPEAT, _sre.MIN_REPEAT) and arg[0] > 0:
            known.append(_cues(arg[2]))
        elif op is _sre.BRANCH:
            each = [_cues(x) for x in arg[1]]
            known.append(None if None in each else frozenset().union(*each))
    return max((k for k in known if k), key=lambda k: (min(map(len, k)), -len(k)), default=None)


_CUES = [_cues(re._parser.parse(r.pattern, r.flags)) for r in PLAIN]
_ALWAYS = [r for r, cues in zip(PLAIN, _CUES) if cues is None]
_CUED = sorted((cue, i) for i, cues in enumerate(_CUES) for cue in cues or ())


def vote(statement: str) -> bool:
    """Whether any phrase or response-status rule speaks for residue: the weak label.

    In ASCII only the rules of which a cue is there are tried; other letters may be equal to a cue's but for case.
    """
    if MARKS.intersection(statement) and any(r.search(statement) for r in MARKED):
        return True
    if not statement.isascii():
        return any(r.search(statement) for r in PLAIN)
    small = statement.lower()
    return any(r.search(statement) for r in _ALWAYS) or any(PLAIN[i].search(statement) for i in {i for cue, i in _CUED if cue in small})


_TOKEN = re.compile(r"[^\W\d_]+|\d+|_+|[^\w\s]+")
_MASK = (1 << BITS) - 1
_EDGES = (zlib.crc32(b"^"), zlib.crc32(b"$"))


@lru_cache(maxsize=200_000)
def _code(token: str) -> int:
    return zlib.crc32(("0" * min(len(token), 3) if token.isdigit() else token.lower()).encode())


def _form(statement: str, tokens: Sequence[str]) -> list[int]:
    """Length and title features of a statement."""
    words = sum(t.isalpha() for t in tokens)
    upper = words > 0 and statement.upper() == statement
    title = "ended" if re.search(r"[.!?]\W*$", statement) else "title" if words < 7 else "open"
    marks = min(4, sum(not t.isalnum() for t in tokens) * 10 // max(1, len(tokens)))
    return [zlib.crc32(x.encode()) & _MASK for x in (f"len{min(len(tokens).bit_length(), 7)}", f"marks{marks}", f"upper{upper}", title)]


class Coded:
    """Statements as hashed words, numbers and marks between edge marks, all in one row, with their n-grams up to three."""

    def __init__(self, statements: Sequence[str]):
        codes, self.form, ends = [], [], [0]
        for s in statements:
            tokens = _TOKEN.findall(s)
            self.form.append(_form(s, tokens))
            codes += [_EDGES[0], *map(_code, tokens), _EDGES[1]]
            ends.append(len(codes))
        self.starts = np.array(ends, dtype=np.int64)
        h = np.array(codes, dtype=np.uint64)
        far = lambda i: np.concatenate((h[i:], np.zeros(min(i, len(h)), np.uint64)))
        mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
        two = h * np.uint64(31) + far(1) * np.uint64(1_000_003)
        self.grams = [mix(h), mix(two + np.uint64(7)), mix(two * np.uint64(31) + far(2) * np.uint64(998_244_353) + np.uint64(13))]
        self.forms = np.array(self.form, dtype=np.int64).reshape(-1, 4)

    def features(self, i: int, begin: int, end: int) -> np.ndarray:
        """Feature numbers of the piece ``begin:end`` of statement i; the whole one has its form features too."""
        a, b = self.starts[i] + begin, self.starts[i] + end
        parts = [g[a : b - n] for n, g in enumerate(self.grams)]
        return np.concatenate([*parts, self.forms[i]]) if b - a == self.starts[i + 1] - self.starts[i] else np.concatenate(parts)

    def margins(self, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(margin, begin, end)`` of each statement: of it or its piece with the largest margin.

        Sums over pieces are differences of running sums, so all positions cost as much as one. A sum is scaled by the
        root of its number of features, so that length alone decides nothing.
        """
        lengths = np.diff(self.starts)
        n = len(lengths)
        run = [np.concatenate(([0.0], np.cumsum(weights[g], dtype=np.float64))) for g in self.grams]
        total = lambda a, b: sum(r[np.maximum(b - i, a)] - r[a] for i, r in enumerate(run))
        whole = (total(self.starts[:-1], self.starts[1:]) + weights[self.forms].sum(1)) / np.sqrt(3 * lengths + 1) + bias
        best, begin, end = np.where(lengths <= PIECES[-1], whole, -np.inf), np.zeros(n, np.int64), lengths.copy()
        for size in PIECES:
            count = np.maximum(lengths - size + 1, 0) * (lengths > size)
            some = np.flatnonzero(count)
            if not len(some):
                continue
            firsts = np.concatenate(([0], np.cumsum(count[some])[:-1]))
            inside = np.arange(count.sum()) - np.repeat(firsts, count[some])
            at = np.repeat(self.starts[some], count[some]) + inside
            m = total(at, at + size) / np.sqrt(3 * size - 3) + bias
            top = np.maximum.reduceat(m, firsts)
            hits = np.flatnonzero(m == np.repeat(top, count[some]))
            owner = np.repeat(np.arange(len(some)), count[some])[hits]
            place = np.empty(len(some), np.int64)
            place[owner[::-1]] = inside[hits[::-1]]
            better = top > best[some]
            rows = some[better]
            best[rows], begin[rows], end[rows] = top[better], place[better], place[better] + size
        return best, begin, end


def _fit(rows: list[np.ndarray], y: np.ndarray, rng: np.random.Generator, start: tuple[np.ndarray, float] | None, epochs: int, l2: float, rate: float) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised logistic regression, by AdaGrad over mini-batches with balanced classes."""
    weights, bias = start or (np.zeros(1 << BITS), 0.0)
    g2, gb = np.full(1 << BITS, 1e-6), 1e-6
    balance = np.where(y > 0, max(1.0, (y == 0).sum() / max(1, y.sum())) ** 0.5, 1.0)
    lens = np.array([len(r) for r in rows])
    ends = np.concatenate(([0], np.cumsum(lens)))
    flat = np.concatenate(rows)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 256):
            batch = order[at : at + 256]
            n = lens[batch]
            starts = np.concatenate(([0], np.cumsum(n)[:-1]))
            cols = flat[np.repeat(ends[batch] - starts, n) + np.arange(n.sum())]
            scale = 1 / np.sqrt(n)
            margin = np.add.reduceat(weights[cols], starts) * scale + bias
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[batch]) * balance[batch]
            used, back = np.unique(cols, return_inverse=True)
            grad = np.bincount(back, weights=np.repeat(error * scale, n)) / len(batch) + l2 * weights[used]
            g2[used] += grad**2
            weights[used] -= rate * grad / np.sqrt(g2[used])
            gb += error.mean() ** 2
            bias -= rate * error.mean() / gb**0.5
    return weights, float(bias)


def _labelled(statement: str) -> list[tuple[int, int]]:
    """The pieces around each rule's first match, in tokens behind the edge mark."""
    found = list(_TOKEN.finditer(statement))
    begins, ends, pieces = [t.start() for t in found], [t.end() for t in found], set()
    for a, b in (m.span() for r in RULES if (m := r.search(statement))):
        i, k = bisect_right(ends, a), bisect_left(begins, b)  # tokens i .. k - 1 hold the match
        for size in PIECES:
            if size < len(found) + 2 and k - i <= size:
                at = min(max(0, (i + k - size) // 2 + 1), len(found) + 2 - size)
                pieces.add((at, at + size))
    return sorted(pieces)


def train(statements: Sequence[str], voted: Sequence[bool], epochs: int = 4, l2: float = 1e-5, rate: float = 0.5, seed: int = 7) -> tuple[np.ndarray, float]:
    """The classifier of statements and their pieces from weak labels of statements.

    A voted statement teaches by its pieces around the matches, and as a whole unless it is long. One without a vote teaches as
    a whole and by a random piece of each size, and after the first fit by its piece that looked most like residue.
    """
    rng, coded, y = np.random.default_rng(seed), Coded(statements), np.asarray(voted, dtype=bool)
    lengths = np.diff(coded.starts)
    rows, labels = [], []

    def teach(i: int, begin: int, end: int) -> None:
        rows.append(coded.features(i, begin, end))
        labels.append(float(y[i]))

    for i, n in enumerate(lengths.tolist()):
        if n <= PIECES[-1]:
            teach(i, 0, n)
        for begin, end in _labelled(statements[i]) if y[i] else [(int(rng.integers(n - s + 1)), s) for s in PIECES if n > s]:
            teach(i, begin, end if y[i] else begin + end)
    weights, bias = _fit(rows, np.array(labels), rng, None, epochs, l2, rate)
    margin, begin, end = coded.margins(weights, bias)
    for i in np.flatnonzero(~y & (end - begin < lengths) & (margin > -2)).tolist():
        teach(i, int(begin[i]), int(end[i]))
    return _fit(rows, np.array(labels), rng, (weights, bias), epochs, l2, rate)


def normal(statement: Column) -> Column:
    """Statements that differ only in ids and numbers beyond a status code are scored once."""
    s = F.trim(statement)
    numbered = F.regexp_replace(F.regexp_replace(s, r"\b(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{8,}\b", "0a1b2c3d4e"), r"(?<![\w.])(?![45]\d\d\b)\d+(?![\w.])", "7")
    return F.when(F.translate(s, "0123456789", "") == s, s).otherwise(numbered)


def statements(documents: DataFrame, *keep: str) -> DataFrame:
    """``keep, statement``: the non-blank statements of each text; null and blank texts have none.

    Sentences are cut with literal replacements, as a regular expression over whole texts costs several times more.
    """
    parted = F.translate("text", "\t\r\u00a0", "   ")
    for mark in (".", "!", "?"):
        parted = F.replace(parted, F.lit(f"{mark} "), F.lit(f"{mark}\n"))
    cut = documents.select(*keep, F.explode(F.split(parted, "\n")).alias("statement"))
    return cut.select(*keep, normal(F.col("statement")).alias("statement")).where("length(statement) > 0")


def _voted(found: DataFrame) -> DataFrame:
    """All of ``found`` with the rules' vote on its statement; they run in Arrow batches, spread out, in an order that stays."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.assign(voted=[vote(s) for s in p.statement])

    spark = found.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = found.repartition(parts, F.xxhash64("statement")).sortWithinPartitions("statement")
    return spread.mapInPandas(judge, StructType([*found.schema, StructField("voted", BooleanType())]))


def _fitted(found: DataFrame) -> tuple[np.ndarray, float] | None:
    """Weights and bias from the bounded sample of ``found(statement, voted)`` in hash order; None without any vote in it."""
    taken = found.select("statement", "voted").orderBy(F.xxhash64("statement"), "statement").limit(MAX_SAMPLE)
    sample = taken.toPandas().sort_values("statement", ignore_index=True)
    if not sample.voted.any():
        return None
    weights, bias = train(sample.statement.tolist(), sample.voted.tolist())
    return weights.astype(np.float32), bias


def _lesson(found: DataFrame, weights: np.ndarray, bias: float) -> tuple[int, np.ndarray, float]:
    """How many statements the classifier judges against their votes, and its weights and bias after all of ``found`` taught it.

    Each part goes on with the fit by its voted statements and by those without a vote that look like residue, as in
    :func:`train`. A weight becomes the mean of the parts that met its feature, by how often they did. Only these sums
    reach the driver, at most one row per feature.
    """

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, labels, wrong = [], [], 0

        def teach(features: np.ndarray, label: float) -> None:
            rows.append(features)
            labels.append(label)

        for p in batches:
            s, y = p.statement.tolist(), p.voted.to_numpy(dtype=bool)
            coded = Coded(s)
            margin, begin, end = coded.margins(weights, bias)
            wrong += int(((_probability(margin) >= MIN_PROBABILITY) != y).sum())
            for i in np.flatnonzero(y | (margin > NEAR)).tolist():
                if not y[i]:
                    teach(coded.features(i, int(begin[i]), int(end[i])), 0.0)
                    continue
                n = int(coded.starts[i + 1] - coded.starts[i])
                for a, b in [(0, n)] * (n <= PIECES[-1]) + _labelled(s[i]):
                    teach(coded.features(i, a, b), 1.0)
        yield pd.DataFrame({"at": [-2], "met": [wrong], "moved": [0.0]})
        if rows:
            after, b = _fit(rows, np.array(labels), np.random.default_rng(7), (weights.astype(np.float64), bias), 2, 1e-5, 0.5)
            met = np.bincount(np.concatenate(rows), minlength=1 << BITS)
            at = np.flatnonzero(met)
            yield pd.DataFrame({"at": at, "met": met[at], "moved": met[at] * (after[at] - weights[at])})
            yield pd.DataFrame({"at": [-1], "met": [len(rows)], "moved": [len(rows) * (b - bias)]})

    parts = found.select("statement", "voted").mapInPandas(learn, "at long, met long, moved double")
    sums = parts.groupBy("at").agg(F.sum("met").alias("met"), F.sum("moved").alias("moved")).toPandas()
    moved = sums.moved / sums.met.clip(lower=1)
    after, of = weights.astype(np.float64), sums["at"].to_numpy()
    after[of[of >= 0]] += moved[of >= 0]
    return int(sums.met[of == -2].sum()), after.astype(np.float32), bias + float(moved[of == -1].sum())


def _taught(found: DataFrame, weights: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Weights and bias after rounds of lessons from all of ``found(statement, voted)``, as long as each halves what is judged against the votes."""
    best, before = (weights, bias), None
    for _ in range(ROUNDS):
        wrong, *after = _lesson(found, weights, bias)
        if before is None or wrong < before:
            best = weights, bias
        if wrong == 0 or before is not None and wrong > before / 2:
            break
        before, (weights, bias) = wrong, after
    return best


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def probabilities(statements_: Sequence[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """How likely each statement is residue, or its most suspicious piece."""
    return _probability(Coded(statements_).margins(weights, bias)[0])


def residue_statements(documents: DataFrame) -> DataFrame:
    """``statement, probability`` of the distinct statements that a rule or the classifier takes for residue.

    Statements are made distinct before they reach Python. Where ``MAX_SAMPLE`` does not hold them all, what the sample lacks
    is taught from all of them. Without any vote nothing is residue.
    """
    found = materialise(_voted(statements(documents).distinct()), "statements")
    if found.where("voted").isEmpty():
        return found.limit(0).select("statement", F.lit(0.0).alias("probability"))
    weights, bias = _fitted(found) or (np.zeros(1 << BITS, np.float32), 0.0)
    if found.count() > MAX_SAMPLE:
        weights, bias = _taught(found, weights, bias)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = p[["statement"]].assign(probability=probabilities(p.statement.tolist(), weights, bias))
            yield out[p.voted | (out.probability >= MIN_PROBABILITY)]

    return found.mapInPandas(judge, "statement string, probability double")


def residue_documents(documents: DataFrame) -> DataFrame:
    """``doc_id`` of every document with a residue statement, each once.

    The residue statements are written first, so that the join is planned by their true size.
    """
    found = materialise(residue_statements(documents).select("statement"), "residue")
    return statements(documents, "doc_id").join(found, "statement", "left_semi").select("doc_id").distinct()


def clean_documents(documents: DataFrame) -> DataFrame:
    """The documents without residue, all columns unchanged; null texts stay."""
    return documents.join(residue_documents(documents), "doc_id", "left_anti")


def validation(documents: DataFrame) -> DataFrame:
    """``part, statements, voted, precision, recall`` of the classifier after its first fit, by itself, against the weak labels.

    A quarter of the sources by hash is held out. A statement counts as held out only if no source outside of that quarter has
    one of its template, that is of the same letters but for case, numbers and marks. Only the fit takes a bounded sample, of
    the other statements; all distinct statements are scored and counted.
    """
    host = F.regexp_replace(F.lower(F.trim(F.coalesce("source", F.lit("")))), "[^a-z0-9]", "_")
    unseen = F.pmod(F.xxhash64("host"), F.lit(1000)) < int(1000 * HELD_OUT)
    shape = F.xxhash64(F.regexp_replace(F.lower("statement"), r"[^\p{L}]+", " "))
    per = statements(documents.withColumn("host", host), "host").groupBy("statement").agg(F.min(unseen).alias("unseen")).withColumn("shape", shape)
    whole = per.groupBy("shape").agg(F.min("unseen").alias("held"))
    found = materialise(_voted(per.join(whole, "shape").select("statement", F.when(F.col("held"), "held_out").otherwise("seen").alias("part"))), "statements")
    model = _fitted(found.where("part = 'seen'"))
    weights, bias = model or (np.zeros(1 << BITS, np.float32), -30.0)  # without any vote nothing is residue

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p[["part", "voted"]].assign(found=probabilities(p.statement.tolist(), weights, bias) >= MIN_PROBABILITY)

    judged = found.mapInPandas(judge, "part string, voted boolean, found boolean")
    right = F.count_if(F.col("found") & F.col("voted"))
    return judged.groupBy("part").agg(
        F.count(F.lit(1)).alias("statements"),
        F.count_if("voted").alias("voted"),
        (right / F.greatest(F.lit(1), F.count_if("found"))).alias("precision"),
        (right / F.greatest(F.lit(1), F.count_if("voted"))).alias("recall"),
    )
