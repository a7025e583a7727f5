"""Problem 10: template residue, filler and error-page text.

Three detectors, all regular expressions and counts over a document's own text:

* placeholders by one grammar per delimiter.  One counts unless its surroundings show that it is
  spoken of and not left over: inside a fenced or inline code span, <pre>/<code>, quotation marks or
  mathematics, in program text (density of code lines), or beside words of explanation;
* messages (errors, refused access, script notices, loading and stub pages) by grammars of
  sentences: a status line, a thing with a failing state, an order to the reader about scripts or
  cookies, an announcement.  A sentence that reports such a message doesn't count.  A document is a
  message if such sentences make up half of it or more, page chrome aside;
* filler by density: the share of words in runs that repeat with a short period, the share of word
  pairs seen before, and the share of pseudo-Latin words.

Defined results: null and blank texts are not residue; repeated rows each get their own verdict;
extra columns are ignored; whole texts are read, however long.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm import codepoints as cpx
from fathomgrid.llm.batches import map_texts

_NAME = r"[A-Za-z][A-Za-z0-9_. -]*"
#: One grammar per delimiter.  No name spans a line or another delimiter, so the scan is linear.
PLACEHOLDERS = re.compile(
    r"\{\{\{?\s*[#/^>&!]?\s*" + _NAME + r"\s*(?:\|[^{}\n]*)?\}\}"  # {{ name }}
    r"|\$\{" + _NAME + r"\}"  # ${name}
    r"|\#\{" + _NAME + r"\}"  # #{name}
    r"|(?<![\w\\{}$#%\]^_)*])\{[a-z]+(?:_[a-z0-9]+)*\}(?!\})"  # {first_name}
    r"|<%[=-]?\s*" + _NAME + r"\s*-?%>"  # <%= name %>
    r"|\{%\s*" + _NAME + r"\s*%\}"  # {% name %}
    r"|%[A-Z][A-Z0-9_]+%|%\([a-z_]+\)[sd]"  # %NAME%, %(name)s
    r"|@@[A-Za-z][A-Za-z0-9_]*@@"  # @@NAME@@
    r"|__[A-Z][A-Z0-9_]+__"  # __NAME__
    r"|\[(?:INSERT|Insert|insert|YOUR|Your|your|ENTER|Enter|enter|ADD|Add)\b[^\[\]\n]+\](?!\()"  # [your name]
    r"|<(?:[a-z]+_[a-z_]+|(?:your|insert|enter|author|project|company|first|last|user)[ _-][a-z_ -]+)>"  # <first_name>, <author name>
    r"|\((?:to be (?:filled in|completed|determined)|fill in here|insert here)\)"
)
#: Spans in which text is quoted: code fences, HTML code, inline code, quotations, and mathematics.
_QUOTED = re.compile(
    r"^(?:```|~~~)[^\n]*\n.*?(?:^(?:```|~~~)[ \t]*$|\Z)"
    r"|<(pre|code|script|style)\b[^>]*>.*?(?:</\1>|\Z)"
    r"|``[^`]+``|`[^`\n]+`"
    r"|\$\$.*?\$\$"
    r"|[\"“„«][^\"“”„«»\n]*[\"”“»]",
    re.S | re.M | re.I,
)
_TALK = re.compile(r"\b(?:the form|the placeholder|placeholders?|the variable|expands?|is replaced by|templates? use|syntax|written as|escaped?)\b", re.I)
_CODE_LINE = re.compile(r"^\s*(?:def |class |import |from \w+ import|return\b|if\b.*[:{]$|for\b.*[:{]$|func |pub fn |fn |let |const |var |export |public |private |#include|\}|\{|//|/\*)|[;{}]\s*$", re.M)

# The words that fill the places of the sentence grammars, in four languages.
_REASON = r"(?:not found|bad (?:gateway|request)|internal server error|service unavailable|gateway time-?out|forbidden|unauthori[sz]ed|too many requests|gone|server error)"
_THING = r"(?:pages?|sites?|address|adresse|files?|documents?|resources?|recurso|urls?|servers?|servidor|serveur|services?|servicio|connection|conexión|connexion|requests?|session|database|datenbank|link|página|seite|access|acceso|accès|zugriff|permission|app|website)"
_STATE = (
    r"(?:not (?:be )?found|(?:can ?not|can't|could not|couldn't|unable to) (?:\w+ )?(?:find|be found|complete|load|open|connect|process|establish)|does(?: not|n't) exist|no longer exists?|unavailable|not available|denied|forbidden|refused|expired|timed out|been (?:moved|removed|deleted)"
    r"|(?:be )?(?:down|closed) for maintenance|unexpected (?:condition|error)|not (?:authori[sz]ed|permitted|allowed)|limited your|do(?:es)? not have permission|nicht (?:gefunden|verfügbar|mehr)|gibt es (?:\S+ ){0,3}nicht|verweigert|abgelaufen|introuvable|indisponible|n'existe (?:plus|pas)|refusé|expirée?|no (?:encontrad[ao]|disponible|existe)|ya no está|denegado|caducado)"
)
_SCRIPT = r"(?:java ?script|scripts?|scripting|cookies?)"
_SWITCH = r"(?:enabled?|activat\w+|active|activer|activar|aktivier\w*|habilit\w+|turn(?:ed)? on|switch(?:ed)? on|allow|requires?|needs?|without|disabled|turned off|checking)"
#: Sentence grammars by kind, over lower-case sentences.
GRAMMARS = {
    "access": [r"^\W*(?:access denied|zugriff verweigert|accès refusé|acceso denegado|forbidden|too many requests|unauthori[sz]ed)\b", rf"\b(?:you|sie|vous|usted)\b.*\b(?:not have permission|not authori[sz]ed|not allowed|keine berechtigung)\b", r"\b(?:session|sitzung|sesión) (?:has |ist |ha )?(?:expired|abgelaufen|caducado)\b", r"^\W*(?:please )?(?:sign|log) ?in (?:again )?to\b", r"\bverify (?:that )?you are (?:a )?human\b|\bare you a robot\b|\bcomplete the captcha\b", r"\bhas (?:limited|blocked) your\b"],
    "error": [rf"^\W*(?:http\W*[\d.]*\W*|error\W*|oops\W*)?[45]\d\d\W{{1,3}}{_REASON}", rf"\b{_THING}\b.*\b{_STATE}", rf"\b{_STATE}\b.*\b{_THING}\b", r"\b(?:an|unknown|fatal|application)? ?error (?:occurred|establishing|while|\d)", r"\bsomething went wrong\b", r"\b(?:fehler|erreur|error code|código de error)\W{0,2}\d", r"^\W*oops\b", rf"^\W*(?:we|it|this|that)\b.*\b{_STATE}", r"\btraceback \(most recent call last\)", r"\b(?:reload|refresh) (?:the|this) page\b", r"\b(?:please )?(?:try|come) (?:again|back) (?:in|later)\b"],
    "script": [rf"\b{_SWITCH}\b.*\b{_SCRIPT}\b", rf"\b{_SCRIPT}\b.*\b{_SWITCH}\b", r"^\W*noscript\b", r"^\W*checking your browser\b", r"\bturn it on to\b", r"\bneeds them to show\b"],
    "stub": [r"^\W*(?:coming soon|demnächst|bientôt disponible|próximamente)\b", r"\b(?:page|section|seite|página) (?:is |wurde |est )?(?:intentionally|absichtlich|intencionadamente)? ?(?:left )?(?:blank|empty|leer|vide)\b", r"^\W*(?:todo|tbd|fixme|xxx)\b(?!\s+list)", r"^\W*(?:loading|please wait|wird geladen|chargement en cours|cargando)\b", r"\bunder construction\b", r"\bno content yet\b"],
    "filler": [r"\b(?:text|content|title|description|paragraph|words?) (?:goes|go|belongs?|to come) ?here\b", r"\b(?:sample|dummy|placeholder|filler|body) (?:text|content|copy)\b", r"\b(?:replace|fill in) this (?:block|text|line|section)\b", r"^\W*(?:insert|write|add|type) (?:your|the|a)? ?(?:text|own|title|paragraph|content)\b", r"\byour paragraph about\b", r"\b(?:hier steht später|aquí irá el texto|texto? (?:de relleno|à compléter|de remplissage)|texte (?:à compléter|de remplissage)|contenido de ejemplo)\b", r"\btext to come\b|\bbelongs here\b", r"\b(?:yyyy|jjjj|aaaa)-(?:mm|mes)-(?:dd|tt|jj)\b"],
}
_GRAMMARS = {k: re.compile("|".join(f"(?:{g})" for g in v)) for k, v in GRAMMARS.items()}
#: Values that a script wrote in place of content.
_NOTHING = re.compile(r"^(?:\W*(?:undefined|nan|null|none|\[object \w+\]|\d+)\W*)+$|\[object \w+\]")
#: A sentence that reports a message, not one that is one.
_REPORT = re.compile(r"\b(?:answers?|answered|returns?|returned|responds?|messages?|handlers?|errors? (?:of|in|from|rate|budget)|limit|counted|logged?|redirects?|test(?:s|ed)?|designers?)\b")
#: Word parts of which every message grammar holds one: sentences without them are passed over.
TRIGGERS = (
    "400 401 403 404 408 410 429 500 501 502 503 504 found exist available denied forbidden refus expir timed moved closed down unexpected permi authori verfügbar gefunden gibt verweigert abgelaufen introuvable disponible indisponible encontrad denegado caducado está "
    "error fehler erreur código wrong traceback again back reload refresh log sign robot human captcha limited blocked script cookie checking turn needs oops can't cannot couldn't unable could "
    "soon bald demnächst bientôt próximamente blank empty leer vide todo tbd fixme xxx loading wait geladen chargement cargando construction content here texte texto text copy replace fill insert write add type paragraph später yyyy jjjj aaaa undefined nan null none object many requests refusé requires"
).split()
#: Syllables of pseudo-Latin filler.
LATIN = "ad al am bor cin com con dex do dol ea el em erc et ex iam ip iq is it la lam lor mco mod ni nos or pis qui sec sed si sit sum tet tru tur ul ut ven".split()
_LATIN_WORD = re.compile("(?:" + "|".join(sorted(LATIN, key=len, reverse=True)) + "|ipsum|lorem)+")
_TAG = re.compile(r"<[^<>]*>")
_SENTENCE_END = re.compile(r"[.!?…]+[\"”’')\]]*(?:\s+|\Z)|\n+|[。！？]")
#: Page chrome: menus, copyright lines, reference numbers, product and build lines.
_CHROME = re.compile(r"^[^\n|]+(?:\|[^\n|]+){2,}$|^©[^\n]*$|^(?:\S+ ){0,3}(?:reference|request id|trace|incident|build|version|ray)\W{0,2}[\w-]*\d[\w.-]*\W*$|^\W*[^\W\d][\w-]*/\d[\w.]*$", re.M | re.I)
#: Shares from which a text is a message or filler.
MESSAGE, PERIODIC, PAIRS = 0.5, 0.3, 0.5
#: Longest period in words of a repeated phrase, and words that a periodic run has at least.
PERIOD, RUN = 12, 8

_STATE_CACHE: dict = {}


def _latin_marks() -> np.ndarray:
    if "latin" not in _STATE_CACHE:
        marks = np.zeros(1 << 20, dtype=bool)
        cp, off = cpx.explode([*(s for s in LATIN if s not in ("ad", "al", "am", "is", "it", "la", "el", "et", "ex", "do", "or", "si", "con")), "ipsum"])
        marks[(cpx.words(cp, off)[0] >> np.uint64(44)).astype(np.int64)] = True
        _STATE_CACHE["latin"] = marks
    return _STATE_CACHE["latin"]


def _automaton():
    if "triggers" not in _STATE_CACHE:
        import ahocorasick

        a = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for w in TRIGGERS:
            a.add_word(w)
        a.make_automaton()
        _STATE_CACHE["triggers"] = a
    return _STATE_CACHE["triggers"]


def _left_over(text: str) -> tuple[int, str | None]:
    """Placeholders that stand where a value belongs, and the first of them."""
    found = list(PLACEHOLDERS.finditer(text))
    if not found:
        return 0, None
    quoted = [m.span() for m in _QUOTED.finditer(text)]
    lines = text.count("\n") + 1
    if lines >= 4 and len(_CODE_LINE.findall(text)) > 0.6 * lines:
        return 0, None  # program text
    n, first = 0, None
    for m in found:
        if any(a <= m.start() and m.end() <= b for a, b in quoted):
            continue
        before, after = text[max(0, m.start() - 60) : m.start()], text[m.end() : m.end() + 60]
        if _TALK.search(before.rpartition(". ")[2]) or _TALK.search(re.split(r"[.\n]", after, maxsplit=1)[0]):
            continue
        n, first = n + 1, first or m.group()
    return n, first


def _message_share(low: str) -> tuple[dict, float]:
    """Characters in sentences that are a message, by kind, and their share of the text without chrome."""
    body = _CHROME.sub("", _TAG.sub(" ", low) if "<" in low else low)
    triggers = _automaton()
    if not any(True for _ in triggers.iter(body)):
        return {}, 0.0
    sentences = [y for x in _SENTENCE_END.split(body) if (y := x.strip())]
    total = sum(map(len, sentences))
    some = [x for x in sentences if any(True for _ in triggers.iter(x))]
    if sum(map(len, some)) < MESSAGE * total:
        return {}, 0.0
    kinds: dict = {}
    for x in some:
        if _REPORT.search(x):
            continue
        kind = "error" if _NOTHING.search(x) else next((k for k, g in _GRAMMARS.items() if g.search(x)), None)
        if kind:
            kinds[kind] = kinds.get(kind, 0) + len(x)
    return kinds, sum(kinds.values()) / max(1, total)


def _periodic(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Words of each row that stand in a run of at least RUN words repeating with a period up to PERIOD."""
    inside = np.zeros(len(h), dtype=bool)
    for p in range(1, PERIOD + 1):
        if len(h) <= p:
            break
        same = (h[p:] == h[:-p]) & (row[p:] == row[:-p])
        edge = np.flatnonzero(np.diff(np.concatenate(([0], same.astype(np.int8), [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= max(RUN, p) and row[a] == row[b + p - 1]:
                inside[a : b + p] = True
    return np.bincount(row[inside], minlength=n)


def _verdicts(batch: pa.RecordBatch) -> pa.Table | None:
    latin = _latin_marks()
    text, cp, off = cpx.from_arrow(batch.column("text"))
    n = batch.num_rows
    h, row, _, _ = cpx.words(cp, off)
    nwords = np.bincount(row, minlength=n)
    latin_n = np.bincount(row[latin[(h >> np.uint64(44)).astype(np.int64)]], minlength=n)
    periodic = _periodic(h, row, n)
    x, first = cpx.shingles(h, row, 2)
    pairs = np.bincount(row[first], minlength=n)
    r = row[first]
    # the text's share that lies in word pairs seen before in the same text
    order = np.lexsort((x, r))
    again = np.zeros(len(x), dtype=bool)
    same = (x[order][1:] == x[order][:-1]) & (r[order][1:] == r[order][:-1])
    again[order[1:][same]] = True
    repeats = np.bincount(r[again], minlength=n)
    out = []
    ids = batch.column("doc_id").to_pylist()
    for i in range(n):
        t = text[off[i] : off[i + 1]]
        if not t or t.isspace():
            continue
        count, evidence = _left_over(t)
        kind, share = "placeholder" if count else None, 0.0
        if not kind:
            low = t.lower()
            kinds, share = _message_share(low)
            if share >= MESSAGE:
                kind = max(kinds, key=kinds.get)
            elif periodic[i] >= PERIODIC * nwords[i] > 0 or (pairs[i] >= 3 and repeats[i] > PAIRS * pairs[i]):
                kind = "filler"
            elif nwords[i] >= 6 and latin_n[i] >= 0.04 * nwords[i]:
                w = re.findall(r"[^\W\d_]+", low)
                if sum(1 for z in w if _LATIN_WORD.fullmatch(z)) > 0.5 * len(w):
                    kind = "filler"
        if kind:
            out.append((ids[i], kind, count, round(share, 4), evidence))
    if not out:
        return None
    c = list(zip(*out))
    return pa.table({"doc_id": pa.array(c[0], pa.int64()), "kind": pa.array(c[1]), "placeholders": pa.array(c[2], pa.int32()), "message_share": pa.array(c[3], pa.float64()), "evidence": pa.array(c[4], pa.string())})


def residue_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, placeholders, message_share, evidence) of every document that is residue.

    One pass without a shuffle; column pruning leaves two columns of the scan.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length(F.trim("text")) > 0)
    return map_texts(docs, "text", _verdicts, "doc_id long, kind string, placeholders int, message_share double, evidence string")


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that are left: residue excluded, null and blank texts kept as they are."""
    return documents.join(residue_documents(documents).select("doc_id").distinct(), "doc_id", "left_anti")
