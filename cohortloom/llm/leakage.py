"""Held-out passages inside a training corpus, by template windows.

Texts become word templates: numbers, names (persons, drugs, places, calendar) and units turn into typed placeholders.
Windows of five template words are hashed and joined; a document and an item that share windows at two places of the
item are a candidate. A passage of twelve words with one word in eight altered, dropped or added always keeps two
such places, repeated windows counted as often as the item has them. Candidates are then aligned twice: word by
word for passages that are held as they are, and template by template for re-parameterised ones, where the words
behind the slots must map consistently from the item to the document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
MIN_WORDS = 12
#: One word in so many may be altered, dropped or added.
PER_EDIT = 8
WORD = r"[\p{L}\p{N}]+"
# Words that a re-parameterised item exchanges, by type of slot.
CALENDAR = (
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august "
    "september october november december mon tue wed thu fri sat sun jan feb mar apr jun jul aug sep sept oct nov dec "
    "morning afternoon evening night spring summer autumn fall winter"
).split()
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand first second third fourth fifth sixth half twice once"
).split()
UNITS = (
    "s ms sec second seconds min minute minutes h hr hrs hour hours day days week weeks month months year years mm cm m km inch inches foot feet "
    "mg mcg ug g kg ng pg lb lbs ml dl l cc mmol mol meq iu units unit mv v kv hz khz bpm mmhg kpa cmh2o percent degrees celsius fahrenheit fr gauge"
).split()
DRUGS = (
    "aspirin heparin warfarin digoxin insulin metformin morphine fentanyl furosemide lasix prednisone dexamethasone hydrocortisone amiodarone "
    "adenosine epinephrine norepinephrine dopamine dobutamine nitroglycerin albuterol ipratropium paracetamol acetaminophen ibuprofen naproxen "
    "vancomycin ceftriaxone cefazolin doxycycline levothyroxine gabapentin lorazepam midazolam propofol ketamine clopidogrel spironolactone torsemide bumetanide"
).split()
PERSONS = (
    "smith johnson williams brown jones garcia miller davis rodriguez martinez hernandez lopez wilson anderson thomas taylor moore jackson martin lee "
    "thompson harris clark lewis robinson walker hall young king wright scott green baker adams nelson carter mitchell roberts turner phillips james john robert "
    "michael william david richard joseph mary patricia jennifer linda elizabeth barbara susan sarah karen anna maria peter paul daniel laura emma"
).split()
PLACES = (
    "london paris berlin madrid rome vienna zurich boston chicago houston dallas denver seattle portland atlanta miami philadelphia baltimore cleveland detroit "
    "toronto montreal sydney melbourne dublin lisbon amsterdam brussels munich hamburg barcelona milan america england scotland ireland france germany spain italy "
    "california texas florida virginia ohio york massachusetts"
).split()
DRUG_ENDINGS = "pril olol sartan statin dipine prazole cillin mycin floxacin xaban parin azole tidine semide thiazide caine".split()
TITLES = "dr mr mrs ms miss prof professor doctor nurse".split()
SLOTS = {"n": NUMBERS, "t": CALENDAR, "u": UNITS, "d": DRUGS, "p": PERSONS, "l": PLACES}
MARK = "\u0001"
_KIND = {w: k for k, ws in reversed(SLOTS.items()) for w in ws}
_DIGITS = "0123456789"


def words(text: Column) -> Column:
    """The words of a text in lower case; punctuation, marks and line breaks only separate. Null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def template(tokens: Column) -> Column:
    """Words with typed placeholders for numbers (also with a unit attached), names and units."""

    def coded(w: Column, before: Column) -> Column:
        rest = F.ltrim(w, F.lit(_DIGITS))
        out = F.when((rest == "") | ((rest != w) & rest.isin(UNITS)), MARK + "n")
        for kind, values in SLOTS.items():
            out = out.when(w.isin(values), MARK + kind)
        ended = F.lit(False)
        for e in DRUG_ENDINGS:
            ended = ended | w.endswith(e)
        return out.when(ended & (F.length(w) > 6), MARK + "d").when(F.coalesce(before, F.lit("")).isin(TITLES), MARK + "p").otherwise(w)

    return F.transform(tokens, lambda w, i: coded(w, F.when(i > 0, F.try_element_at(tokens, i))))


def template_words(tokens: Sequence[str]) -> list[str]:
    """:func:`template` of the words of one text."""
    out = []
    for i, w in enumerate(tokens):
        rest = w.lstrip(_DIGITS)
        if rest == "" or (rest != w and rest in UNITS):
            kind = "n"
        elif w in _KIND:
            kind = _KIND[w]
        elif len(w) > 6 and w.endswith(tuple(DRUG_ENDINGS)):
            kind = "d"
        else:
            kind = "p" if i and tokens[i - 1] in TITLES else None
        out.append(MARK + kind if kind else w)
    return out


def windows(df: DataFrame, id_column: str, text: str, size: int = WINDOW, distinct: bool = False) -> DataFrame:
    """``id, window`` for the hashed template windows of each text, once or as often as they occur; shorter texts have none."""
    coded = df.select(F.col(id_column), words(F.col(text)).alias("_t")).select(id_column, F.transform(template(F.col("_t")), lambda w: F.xxhash64(w)).alias("_w"))
    # the hash of a window combines the word hashes inside the JVM: no joined strings are built
    last = F.size("_w") - size
    hashes = F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice("_w", i, size))))
    hashes = F.array_distinct(hashes) if distinct else hashes
    return coded.select(id_column, F.explode(hashes).alias("window"))


def _reach(a: list[str], b: list[str], i: int, j: int, step: int) -> list[int]:
    """Item words gained from (i, j) in direction ``step`` with 0, 1, 2 ... edits, ending on an equal word."""
    n, m = (len(a) - i, len(b) - j) if step > 0 else (i + 1, j + 1)
    front, gains, best = {0: 0}, [0], 0
    for edits in range(n // PER_EDIT + 2):
        slid: dict[int, int] = {}
        for d, x in front.items():
            y, start = x - d, x
            while x < n and y < m and a[i + step * x] == b[j + step * y]:
                x, y = x + 1, y + 1
            slid[d] = x
            if x > start:
                best = max(best, x)
        if edits:
            gains.append(best)
        else:
            gains[0] = best
        front = {}
        for d, x in slid.items():
            for dd, xx in ((d, x + 1), (d + 1, x + 1), (d - 1, x)):
                if xx <= n and 0 <= xx - dd <= m:
                    front[dd] = max(front.get(dd, -1), xx)
        if not front:
            break
    return gains


def _best_passage(a: Sequence[str], b: Sequence[str], min_words: int) -> tuple[int, int, tuple[int, int, int, int]]:
    """(words, edits, (item from, item to, document from, document to)) of the longest passage of ``a`` in ``b``; zeros for none."""
    at: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(a) - WINDOW + 1):
        at.setdefault(tuple(a[i : i + WINDOW]), []).append(i)
    best, where, seen = (0, 0), (0, 0, 0, 0), set()
    for j in range(len(b) - WINDOW + 1):
        for i in at.get(tuple(b[j : j + WINDOW]), ()):
            if (i - 1, j - 1) in seen:
                seen.add((i, j))
                continue
            seen.add((i, j))
            right, left = _reach(a, b, i, j, 1), _reach(a, b, i - 1, j - 1, -1)
            for er, gr in enumerate(right):
                for el, gl in enumerate(left):
                    if gr + gl >= max(min_words, PER_EDIT * (er + el)) and (gr + gl, -er - el) > (best[0], -best[1]):
                        best, where = (gr + gl, er + el), (i - gl, i + gr, max(0, j - gl - el), j + gr + er)
    return *best, where


def held_words(item: Sequence[str], doc: Sequence[str], min_words: int = MIN_WORDS) -> tuple[int, int]:
    """(words of the longest passage of the item that the document holds, edits in it); (0, 0) for none.

    A passage starts and ends on equal words, and its edits number at most one in eight of its item words.
    """
    return _best_passage(list(item), list(doc), min_words)[:2]


def held_template(item: Sequence[str], doc: Sequence[str], min_words: int = MIN_WORDS) -> tuple[int, int, int]:
    """(words of the longest passage whose template the document holds, edits, slots with other words); zeros for none.

    The words in slots of one type must map consistently: each word of the item to one word of the document, its most frequent
    partner. A slot that breaks the mapping counts as an edit, and edits number at most one in eight. At least half of the
    passage must be words outside of slots: bare tables of numbers have no wording to recognise.
    """
    item, doc = list(item), list(doc)
    a, b = template_words(item), template_words(doc)
    held, edits, (i0, i1, j0, j1) = _best_passage(a, b, min_words)
    if not held or 2 * sum(x.startswith(MARK) for x in a[i0:i1]) > held:
        return 0, 0, 0
    pairs = Counter()
    for i, j, n in SequenceMatcher(None, a[i0:i1], b[j0:j1], autojunk=False).get_matching_blocks():
        pairs.update((a[i0 + i + x], item[i0 + i + x], doc[j0 + j + x]) for x in range(n) if a[i0 + i + x].startswith(MARK))
    partner: dict[tuple[str, str], tuple[int, str]] = {}
    for (kind, x, y), n in sorted(pairs.items()):
        partner[kind, x] = max(partner.get((kind, x), (0, "")), (n, y))
    edits += sum(n for (kind, x, y), n in pairs.items() if partner[kind, x][1] != y)
    if held < PER_EDIT * edits:
        return 0, 0, 0
    return held, edits, sum(n for (_, x, y), n in pairs.items() if x != y)


def candidates(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, doc_words, item_words`` of the pairs that share template windows at two places of the item.

    The window join is planned by size: a small item side is broadcast by the session's own threshold, else both sides
    shuffle and adaptive execution splits a hot window's documents. Documents are reduced to distinct windows before it,
    windows that no item has end there, and a pair is counted before it moves on. A document's text is joined to its
    candidates row by row; nothing is gathered per document, item or window.
    """
    d, q = documents.select("doc_id", "text"), items.select("item_id", F.col("text").alias("item_text"))
    wanted = windows(q, "item_id", "item_text").groupBy("item_id", "window").agg(F.count(F.lit(1)).alias("places"))
    met = windows(d, "doc_id", "text", distinct=True).join(wanted, "window")
    near = met.groupBy("doc_id", "item_id").agg(F.sum("places").alias("places")).where("places > 1").drop("places")
    pairs = near.join(q, "item_id").join(d, "doc_id")
    return pairs.select("doc_id", "item_id", words(F.col("text")).alias("doc_words"), words(F.col("item_text")).alias("item_words"))


def leaked_items(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, item_id, held, edits`` of every document that holds a passage of an item.

    Null and short texts match nothing; repeated documents each come out; extra columns are ignored.
    """

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            held = [held_words(a, b, min_words) for a, b in zip(p.item_words, p.doc_words, strict=True)]
            out = p[["doc_id", "item_id"]].assign(held=[h for h, _ in held], edits=[e for _, e in held])
            yield out[out.held > 0]

    pairs = candidates(documents, items)
    types = dict(pairs.dtypes)
    return pairs.mapInPandas(verify, f"doc_id {types['doc_id']}, item_id {types['item_id']}, held int, edits int")


def reworded_items(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, item_id, held, edits, changed``: documents that hold an item with other words in its slots, consistently exchanged.

    Passages that :func:`leaked_items` finds as they are don't come out again. Nulls, short texts and copies as there.
    """

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            held = [(0, 0, 0) if held_words(a, b, min_words)[0] else held_template(a, b, min_words) for a, b in zip(p.item_words, p.doc_words, strict=True)]
            out = p[["doc_id", "item_id"]].assign(**{name: [h[i] for h in held] for i, name in enumerate(("held", "edits", "changed"))})
            yield out[(out.held > 0) & (out.changed > 0)]

    pairs = candidates(documents, items)
    types = dict(pairs.dtypes)
    return pairs.mapInPandas(verify, f"doc_id {types['doc_id']}, item_id {types['item_id']}, held int, edits int, changed int")
