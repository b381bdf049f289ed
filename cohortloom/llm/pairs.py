"""Broken prompt and response pairs, each with its type of defect.

A pushdown parser finds responses that stop inside a fence, bracket, quotation, list or tag; statement
statistics over all responses (see :mod:`.truncation`) find those that stop inside a word or sentence. Greedy
string tiling measures how much of a response is the prompt's own text, script and function-word checks its
language, and a refusal grammar whether it declines.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.truncation import PROSE, cut_statements

#: In order of precedence; a pair has the first that applies.
TYPES = ("empty", "refusal", "copied_prompt", "other_language", "truncated")
#: Tiles shorter than this many words are chance.
MIN_TILE = 4
#: Share of a response's words that tiles must cover to call it a copy.
COPIED = 0.8

_SENTENCE = re.compile(r"(?<=[.!?:])\s+|\s*\n\s*")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_MARKUP = re.compile(r"\"[a-z_]+\"\s*:|<think>\s*</think>|<\|[^|>]*\|>|</?[a-z]+>|```\s*\w*|​|﻿|&nbsp;", re.I)
_HEADING = re.compile(r"^\W*(?:report|findings?|impressions?|summary|answer|response|output|conclusions?|results?|evidence(?:[ _]trace)?|claims?|uncertainties|befund|bericht|informe|ecg|cxr|ekg)\W*$", re.I)
_MARKER = re.compile(r"^\W*(?:(?:no|empty|none|missing) (?:output|response|answer|report|content|text|claims?)(?: (?:available|provided|generated|given|produced))?|not (?:available|provided|generated)|see above|pending|x{3,}|none|null|nil|nan|n\W?a|empty|blank|tbd|json|undefined)\W*$", re.I)


def has_content(text: str | None) -> bool:
    """Whether any line has words besides markup, markers for nothing and bare headings."""
    plain = _MARKUP.sub(" ", text or "")
    return any(_WORD.search(line) and not _HEADING.match(line) and not _MARKER.match(line) for line in plain.splitlines())


_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
_TOKEN = re.compile(r"```|</?[A-Za-z][\w-]*>|[()\[\]{}“”«»\"]")
_JOINING = tuple(",:;([{‐–\\")
_BARE_ITEM = re.compile(r"\s*(?:[-*•]|\d+[.)])")
_VOID = frozenset("br hr img input meta link".split())


def left_open(text: str) -> list[str]:
    """What a pushdown parser still holds at the end: fences, brackets, quotations and tags, outermost first."""
    stack: list[str] = []
    for token in _TOKEN.findall(text):
        if token == "```" or token == '"':
            if token in stack:
                del stack[stack.index(token) :]
            else:
                stack.append(token)
        elif token[0] == "<":
            name = token.strip("</>").lower()
            if token[1] != "/":
                stack.extend([f"<{name}>"] * (name not in _VOID))
            elif f"<{name}>" in stack:
                del stack[len(stack) - 1 - stack[::-1].index(f"<{name}>") :]
        elif token in _PAIRS:
            if _PAIRS[token] in stack:
                del stack[len(stack) - 1 - stack[::-1].index(_PAIRS[token]) :]
        else:
            stack.append(token)
    return stack


def breaks_off(text: str) -> bool:
    """Whether the structure shows a cut: an open fence or object, an open bracket or quotation without a final
    stop, a list mark without its item, or a sentence that stops on a joining mark."""
    body = text.rstrip()
    held = left_open(body)
    if any(x in ("```", "{") or x[0] == "<" for x in held):
        return True
    if held and not re.search(r"[.!?]\W{0,2}$", body[-3:]):
        return True
    return body.endswith(_JOINING) or bool(_BARE_ITEM.fullmatch(body.rpartition("\n")[2]))


_SELF = r"(?:i|we|this (?:assistant|model|system)|the (?:assistant|model|system))"
_TASK = r"(?:assist|help|comply|provide|interpret|describ\w*|draft\w*|writ\w*|generat\w*|creat\w*|produc\w*|answer\w*|read\w* (?:this|the|these) (?:study|image|tracing|recording)|giv\w* (?:a |an |any )?(?:medical|clinical|diagnos)|offer|fulfil\w*|diagnos\w*|complet\w*|discuss\w*|analy[sz]\w*|continue|proceed|do (?:that|this))"
_CLINICAL = r"(?:exclud|rule|assess|be excluded|determin|visuali|see\b|identif)"
# The grammar: who cannot or will not do the task, a request turned down, or the task named as out of bounds.
_REFUSALS = re.compile(
    "|".join(
        (
            rf"\b{_SELF}(?:'m| am| are|'ll| will)? (?:can't|cannot|can not|could not|couldn't|won't|will not|must not|may not|not be able to|am not able to|unable to|not able to|not allowed to|not permitted to|not going to|not in a position to|do not|don't|not comfortable|would rather not|prefer not to)(?! {_CLINICAL})(?: \w+){{0,2}}? {_TASK}",
            rf"\b{_SELF} (?:must |have to |has to |need to |will )?(?:respectfully |politely )?(?:declin\w+|refus\w+)\b",
            rf"\b{_SELF} (?:do|does) not have (?:the )?(?:permission|authori[sz]ation|ability|capability)\b",
            r"\b(?:request|question|task|prompt)\b[^.]{0,60}\b(?:outside|against|beyond|violates?|not permitted|not allowed|declined|refused|rejected|denied)\b[^.]{0,80}",
            r"\bwill not be (?:answered|processed|fulfilled|written|issued|generated|drafted|provided)\b",
            r"\b(?:report|answer|response|text|description|draft)\b[^.,;]{0,20} (?:cannot|can't|can not|will not|must not|may not) be (?:provided|generated|written|issued|produced|drafted|created|supplied)\b",
            r"\bno (?:report|answer|interpretation|reading|diagnosis|description|draft) (?:will|can|may) be (?:issued|given|provided|written|generated|drafted|offered)\b",
            r"\b(?:policy|policies|guidelines|rules|terms) (?:do|does|will)? ?(?:not (?:allow|permit)|forbids?|prohibits?|prevents?)\b|\bagainst (?:my|our|the) (?:policy|policies|guidelines|rules)\b",
            r"\bnot (?:be )?(?:appropriate|comfortable|safe|right) for me\b|\b(?:not|n't) feel comfortable\b|\b(?:outside|beyond) (?:of )?(?:my|the) (?:scope|capabilit\w+|abilit\w+|remit|role|permitted|allowed)\b|\boutside what i\b",
            r"\b(?:medical|clinical|diagnostic) (?:advice|opinions?|interpretation) (?:is|are) outside\b",
            r"\b(?:is|'s|was) not something (?:that )?(?:can be done here|(?:i|we)(?: can| am able to| are able to| may| will|'m able to)\b)",
            r"\b(?:not able|unable) to (?:comply|assist|interpret medical|fulfil\w*|help with|provide|generate|complete (?:this|the|your) (?:task|request)|process (?:this|the|your))\b",
            r"\bas an? (?:ai|artificial|language model|large language|text assistant|virtual assistant|language system)\b[^.]{0,80}\b(?:not|can't|cannot|won't|unable|decline|refuse|must)\b",
            r"^\W*(?:(?:task|request|i) )?(?:declined?|refused?)\W*$",
            r"\b(?:ich|wir) (?:kann|können|darf|dürfen|möchte|werde)\b[^.]{0,60}\b(?:nicht|keine?n?)\b[^.]{0,40}\b(?:helfen|erstellen|beantworten|schreiben|beschreiben|liefern|erfüllen|verfassen|geben|ausführen|deuten)\b",
            r"\b(?:kann|darf|werde) ich\b[^.]{0,60}\b(?:nicht|keine?n?)\b[^.]{0,40}\b(?:helfen|erstellen|beantworten|schreiben|beschreiben|liefern|erfüllen|verfassen|geben|ausführen|deuten)\b",
            r"\bich (?:lehne|muss)\b[^.]{0,40}\b(?:ab|ablehnen)\b|\banfrage\b[^.]{0,40}\b(?:abgelehnt|nicht beantwort\w+|nicht erfüll\w+)\b",
            r"\bno (?:puedo|podemos|voy a|me es posible) (?:ayudar|proporcionar|escribir|redactar|generar|describir|cumplir|interpretar|ofrecer|dar|responder|realizar|elaborar)\w*\b",
            r"\bje ne (?:peux|puis|pourrai|suis)\b[^.]{0,60}\b(?:aider|fournir|rédiger|générer|décrire|répondre|interpréter|donner|écrire|produire|établir|traiter)\b",
            r"\bje (?:dois|me vois obligée? de) (?:refuser|décliner)\b|\bje refuse\b|\b(?:demande|requête)\b[^.]{0,40}\b(?:refusée|rejetée|ne peut être traitée)\b",
            r"\bnão (?:posso|podemos|vou|consigo|me é possível) (?:ajudar|fornecer|escrever|redigir|gerar|descrever|cumprir|interpretar|oferecer|dar|responder|realizar|elaborar|produzir)\w*",
            r"\b(?:devo|tenho (?:que|de)) (?:recusar|declinar)\b|\beu recuso\b|\b(?:solicitação|pedido)\b[^.]{0,40}\b(?:recusad[oa]|rejeitad[oa]|negad[oa])\b",
            r"\bnon (?:posso|possiamo|sono in grado di|mi è possibile) (?:aiutar|fornir|scriver|redig|generar|descriver|interpretar|offrir|dar|risponder|elaborar|produr|soddisf)\w*",
            r"\b(?:devo|sono costrett[oa] a) (?:rifiutar|declinar)\w*|\bmi rifiuto\b|\brichiesta\b[^.]{0,40}\b(?:rifiutata|respinta)\b",
            r"\b(?:ik (?:kan|mag|wil|zal)|(?:kan|mag|wil|zal) ik)\b[^.]{0,60}\b(?:niet|geen)\b[^.]{0,40}\b(?:helpen|geven|schrijven|opstellen|genereren|beschrijven|beantwoorden|interpreteren|leveren|maken)\b",
            r"\bik (?:moet\b[^.]{0,40}\b(?:weigeren|afwijzen)|weiger)\b|\bverzoek\b[^.]{0,40}\b(?:geweigerd|afgewezen)\b",
            r"\b(?:debo|tengo que|me veo obligado a) (?:rechazar|negarme|declinar)\b|\b(?:solicitud|petición)\b[^.]{0,40}\b(?:rechazada|no puede|no será)\b",
        )
    ),
    re.I,
)


#: A refusal has one of these; most texts have none and skip the grammar.
_CUES = re.compile(
    r"n't|\b(?:cannot|can not|not|no|unable|declin|refus|reject|denied|outside|beyond|against|violat|polic|guidelines|rules|terms|as an? (?:ai|art|lan|lar|text|vir)|nicht|keine?n?|lehne|ablehn|abgelehnt|no puedo|no podemos|rechaz|negarme|declinar|je ne|recus|rejei|negad|não|rifiut|respint|niet|geen|weiger|geweigerd|afgewezen|rejet)", re.I
)


@lru_cache(maxsize=100_000)
def _refuses(sentence: str) -> bool:
    return bool(_CUES.search(sentence) and _REFUSALS.search(sentence))


def declines(text: str | None) -> bool:
    """Whether a sentence declines the task itself; limits of the study or view are none."""
    return any(map(_refuses, _SENTENCE.split((text or "").replace("’", "'"))))


# Function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the is are was were of and with no in on at to for from by be been this that there which may not but or an as has have when",
    "de": "der die das und ist sind im am ein eine einen einem einer kein keine nicht mit von vom zur zum zu bei wird werden des dem den auf für sich es durch wegen hat",
    "es": "el los las del y una con se por que en al es está están no como para su hay más sin muestra de la un este lo",
    "fr": "le les du des et une est il au aux en par pas avec pour ce cette chez dans sur montre de la un sont existe qui que",
    "pt": "o os as da do das dos na no nas nos uma um não com para por em ao é são foi está estão mais sem há se que pelo pela",
    "nl": "de het een en van is zijn op te met voor niet geen er bij naar door aan als dat dit wordt in uit over",
    "it": "il lo gli dei della delle e una è con per che non nel nella sono di la un si in da come mostra alla al sede",
}
_SHARED = Counter(w for v in FUNCTION_WORDS.values() for w in set(v.split()))
_WEIGHT: dict[str, list[tuple[str, float]]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _w in set(_words.split()):
        _WEIGHT.setdefault(_w, []).append((_language, 1 / _SHARED[_w]))


#: Another language must outweigh the expected one by this factor, as neighbours share words.
OUTWEIGHS = 1.25


@lru_cache(maxsize=100_000)
def _script_and_scores(text: str) -> tuple[str | None, dict[str, float]]:
    """The script where it is not Latin, and the weight of each language's function words."""
    if not text.isascii():
        letters = [c for c in text if c.isalpha()]
        foreign = Counter(unicodedata.name(c, "?").split(" ")[0] for c in letters if ord(c) > 0x24F)
        if 2 * sum(foreign.values()) > len(letters):
            return foreign.most_common(1)[0][0].lower(), {}
    score: dict[str, float] = {}
    for w in _WORD.findall(text.lower()):
        for k, x in _WEIGHT.get(w, ()):
            score[k] = score.get(k, 0.0) + x
    return None, score


def language(text: str, expected: str | None = None) -> str | None:
    """A script other than Latin, else the language whose function words weigh most; None where none do or two tie.

    With ``expected``, another language is only named where it clearly outweighs the expected one.
    """
    script, score = _script_and_scores(re.sub(r"\d+", "0", text))
    if script or not score:
        return script
    top = sorted(score.items(), key=lambda x: -x[1])[:2]
    if expected and top[0][1] <= OUTWEIGHS * score.get(expected, 0.0):
        return expected
    return top[0][0] if len(top) == 1 or top[0][1] > top[1][1] else None


def mostly_other(text: str, expected: str | None) -> bool:
    """Whether more than half of the words stand in sentences of another language, quotations left out."""
    if expected is None:
        return False
    plain = re.sub(r"\"[^\"]*\"|“[^”]*”|«[^»]*»", " ", text)
    total = other = 0
    for sentence in _SENTENCE.split(plain):
        n = len(_WORD.findall(sentence))
        found = language(sentence, expected)
        total += n
        other += n if found not in (None, expected) else 0
    return 2 * other > total > 0


#: Tiles are sought from this length on, halved down to the smallest, so that long runs are taken first.
LONGEST_TILE = 64


def _shingles(words: Sequence[str], size: int) -> Iterator[tuple[str, ...]]:
    return zip(*(words[i:] for i in range(size)), strict=False)


def tiled_share(pattern: Sequence[str], text: Sequence[str], min_tile: int = MIN_TILE, times: Sequence[int] | None = None, least: float = 0.0) -> float:
    """Share of ``pattern`` that greedy string tiling covers with ``text``: long common runs first, each word once.

    ``times`` weighs the words of the pattern. A share that can't reach ``least`` is given as 0. Runs are found by hashed
    shingles whose length is halved from ``LONGEST_TILE``; each place of the text is tried once per length, so the work is
    in proportion to both texts, however often they repeat themselves.
    """
    if not pattern:
        return 0.0
    times = [1] * len(pattern) if times is None else times
    floor = min(min_tile, len(pattern))
    known = set(_shingles(text, floor))
    within = [False] * len(pattern)
    for i, x in enumerate(_shingles(pattern, floor)):
        if x in known:
            within[i : i + floor] = [True] * floor
    if sum(n for n, x in zip(times, within, strict=True) if x) < least * sum(times) or not any(within):
        return 0.0  # tiles cover words of matching shingles only: not enough for a copy
    used_p, used_t = bytearray(len(pattern)), bytearray(len(text))
    size = max(floor, min(LONGEST_TILE, len(pattern), len(text)))
    while True:
        at: dict[tuple[str, ...], list[int]] = {}
        for j, x in enumerate(_shingles(text, size)):
            if used_t.find(1, j, j + size) < 0:
                at.setdefault(x, []).append(j)
        for places in at.values():
            places.reverse()
        i = 0
        while i <= len(pattern) - size:
            places = at.get(tuple(pattern[i : i + size])) if used_p.find(1, i, i + size) < 0 else None
            while places and used_t.find(1, places[-1], places[-1] + size) >= 0:
                places.pop()
            if not places:
                i += 1
                continue
            j, n = places.pop(), size
            while i + n < len(pattern) and j + n < len(text) and pattern[i + n] == text[j + n] and not used_p[i + n] and not used_t[j + n]:
                n += 1
            used_p[i : i + n] = used_t[j : j + n] = b"\1" * n
            i += n
        if size == floor:
            return sum(n for n, x in zip(times, used_p, strict=True) if x) / sum(times)
        size = max(floor, size // 2)


_EVIDENCE_LINE = re.compile(r"^\s*(?:anchor\b|ecg\s*:|cxr\s*:|labs?\s*:|ekg\s*:)", re.I)


def _tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _copied_share(body: str, text: Sequence[str]) -> float:
    """Tiled share of a report; a sentence that comes again counts as its first copy does."""
    found = Counter(x for x in (tuple(_tokens(s)) for s in _SENTENCE.split(body)) if x)
    return tiled_share([w for x in found for w in x], text, times=[n for x, n in found.items() for _ in x], least=COPIED)


def pair_defect(prompt: str | None, report: str | None, claims: Sequence[str | None] | None) -> str | None:
    """The defect of one pair by content and structure, or None; ``truncated`` only where structure shows it.

    A null prompt copies nothing and expects no language. A null or empty trace alone is no defect.
    """
    prompt, claims = prompt or "", list(claims) if claims is not None else []
    if not has_content(report) or (claims and not any(has_content(c) for c in claims)):
        return "empty"
    if declines(report) or any(declines(c) for c in claims):
        return "refusal"
    instruction = "\n".join(x for x in prompt.splitlines() if not _EVIDENCE_LINE.match(x))
    body = re.sub(r"^\W*report\W*:\s*", "", _MARKUP.sub(" ", report), flags=re.I)
    whole = _tokens(prompt)
    if _copied_share(body, whole) >= COPIED:
        return "copied_prompt"
    if claims:
        asked = _tokens(instruction)
        if all(tiled_share(_tokens(c or ""), asked, least=COPIED) >= COPIED for c in claims):
            return "copied_prompt"
    expected = language(instruction)
    if mostly_other(body, expected) or (claims and all(mostly_other(c or "", expected) for c in claims)):
        return "other_language"
    if breaks_off(body) or any(breaks_off(c) for c in claims if c):
        return "truncated"
    return None


def defective_pairs(attempts: DataFrame) -> DataFrame:
    """``attempt_id, defect_type`` of the defective attempts with status ``ok``.

    Every attempt is judged by itself in Arrow batches; the statement statistics come from all responses in
    one aggregate. Only defective rows meet in the last aggregate, which keeps the first type by precedence.
    Null reports are empty; repeated attempts each come out; an empty table gives no rows.
    """
    ok = attempts.where("status = 'ok'").select("attempt_id", "prompt", "generated_report", F.transform("evidence_trace", lambda x: x["claim"]).alias("claims"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            found = [pair_defect(a, b, c) for a, b, c in zip(p.prompt, p.generated_report, p.claims, strict=True)]
            kept = p[["attempt_id"]].assign(place=pd.Series([TYPES.index(x) if x else None for x in found], dtype="Int32", index=p.index))
            yield kept[kept.place.notna()]

    judged = ok.mapInPandas(judge, "attempt_id bigint, place int")
    text = lambda source, column: ok.select(F.lit("response").alias("kind"), F.col("attempt_id").alias("record_id"), F.lit(source).alias("source"), column.alias("text"))
    texts = text("report", F.col("generated_report")).unionByName(text("claim", F.explode("claims")))
    records, cut = cut_statements(texts, PROSE)
    stopped = records.join(cut, ["kind", "last"], "left_semi").select(F.col("record_id").alias("attempt_id"), F.lit(TYPES.index("truncated")).alias("place"))
    first = judged.unionByName(stopped).groupBy("attempt_id").agg(F.min("place").alias("place"))
    return first.select("attempt_id", F.element_at(F.array(*map(F.lit, TYPES)), F.col("place") + 1).alias("defect_type"))
