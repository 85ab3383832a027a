"""Sentence boundaries across languages and scripts by a finite transducer.

The rules are compiled to tables over finite classes: ENDS says for the classes
of a mark, the word before it, what closes after it and what follows whether a
sentence may end there (abbreviations, decimals, ordinals, initials, case,
scripts without blanks); STEP and EMIT drive a transducer over (open quotation,
open brackets), so that no sentence ends inside a quotation or bracket.

Every text is cut into chunks, and three passes run over them. Backwards, each
chunk is a function on the set of closing marks still to come in its paragraph;
a suffix scan composes them, so an opening mark knows whether it is ever closed,
at any distance. Forwards, each chunk is a state-transition function (end state
for each start state); a prefix scan gives every chunk its start state. Then
chunks are emitted independently. The chunks of a text of up to LONG code points
are one task's, longer texts are spread over tasks; the functions are the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Code points of a chunk inside a task; beyond LONG a text is spread over tasks in chunks of LONG.
CHUNK, LONG = 512, 1 << 16
#: Context of the lexer before and after a chunk, and how far a cut may move to lie inside a word.
BEFORE, AFTER, MOVE = 128, 1024, 256

# Abbreviations that never end a sentence.
NEVER = frozenset(
    """mr mrs ms dr prof st rev gen sen rep gov hon messrs mme mlle mm sr sra dra srta lic vs cf vol vols pp p fig figs eq eqs
    sec secs ch chap app ed eds ref approx ver al e.g i.e eg ie viz resp dept univ est ca vgl bzw ggf nr abb tab s z.b d.h u.a o.g
    z d b h sog bspw inkl evtl env cap pág págs fig núm art ej p.ej p.ex рис табл стр см ср напр им ул гл п т проф акад डॉ श्री प्रो कु""".split()
)
# Abbreviations that end a sentence only before a capital letter, not before a digit.
BEFORE_DIGIT = frozenset("no nos jan feb mar apr jun jul aug sep sept oct nov dec млн млрд тыс".split())
# Words before a German ordinal number.
ORDINAL_AFTER = frozenset("am im vom zum zur dem den der des die das beim ab bis seit und".split())
# Single small letters that may end a sentence (year, and so on, roubles).
SMALL_END = frozenset("гдпр")

_OPEN = {"„": 2, "“": 3, "«": 4, "「": 5, "『": 5}
_QUOTES = 6  # none, straight, low, high, angle, corner
_DEPTH = 4
# symbols
DUAL, STRAIGHT, OPEN_LOW, OPEN_ANGLE, OPEN_CORNER, CLOSE_HIGH, CLOSE_ANGLE, CLOSE_CORNER, OPEN_PAREN, CLOSE_PAREN, PARAGRAPH, END, OPEN_HIGH, CLOSE_STRAIGHT = range(14)
SYMBOLS = 14


def compile_rules() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emits) by state and symbol; state = quotation * _DEPTH + bracket depth."""
    step = np.zeros((_QUOTES * _DEPTH, SYMBOLS), np.int8)
    emit = np.zeros((_QUOTES * _DEPTH, SYMBOLS), bool)
    for q in range(_QUOTES):
        for d in range(_DEPTH):
            s = q * _DEPTH + d
            to = {k: s for k in range(SYMBOLS)}
            to[PARAGRAPH] = 0
            emit[s, PARAGRAPH] = True
            emit[s, END] = s == 0
            to[OPEN_PAREN] = q * _DEPTH + min(d + 1, _DEPTH - 1)
            to[CLOSE_PAREN] = q * _DEPTH + max(d - 1, 0)
            out = d  # bracket depth outlives a quotation
            if q == 0:
                to[STRAIGHT] = 1 * _DEPTH + out
                to[OPEN_LOW] = 2 * _DEPTH + out
                to[DUAL] = to[OPEN_HIGH] = 3 * _DEPTH + out
                to[OPEN_ANGLE] = 4 * _DEPTH + out
                to[OPEN_CORNER] = 5 * _DEPTH + out
            else:
                for kind, symbols in ((1, [STRAIGHT, CLOSE_STRAIGHT]), (2, [DUAL, CLOSE_HIGH, OPEN_HIGH]), (3, [CLOSE_HIGH]), (4, [CLOSE_ANGLE]), (5, [CLOSE_CORNER])):
                    if q == kind:
                        for k in symbols:
                            to[k] = out
            for k, t in to.items():
                step[s, k] = t
    return step, emit


STEP, EMIT = compile_rules()
STATES = len(STEP)

_EVENT = re.compile(r"\n[^\S\n]*\n\s*|[.!?…。！？।॥]+|[\"„“”«»「」『』()\[\]（）]|(?<=[ก-๛])\s+(?=[ก-๛])")
_CLOSERS = "\"'”’“»」』)]）"
_AHEAD = re.compile(r"(\s*)([\"'“”„«「『(\[（¿¡‘—–-]*\s?)(\S?)(\S?)(\S?)(\S?)(\S?)")
_LEFT = re.compile(r"[^\s\"'“”„«»「」()\[\],;:!?…。！？।/]*\Z")
_LAST_WORD = re.compile(r"([^\W\d_]+)\s+\Z")
_DOTTED = re.compile(r"(?:\d+\.)+\d*")
#: Closing marks an opening one may wait for, one bit each.
_BIT = {c: 1 << i for i, c in enumerate('"“”»」』)]）')}

# classes of marks, of gaps, and of what follows
PERIOD, ELLIPSIS, EXCLAIM, WIDE, DANDA = range(5)
NO_GAP, GAP, EMPTY_LINE = range(3)
NONE, LOWER, CASELESS, OTHER, DIGIT, DIGIT_YEAR, YEAR_ONLY = range(7)
UPPER = 7  # + 1 if what follows looks like the start of a word, + 2 if its second letter is small
NEXTS = 11
# classes of the word before a period; from WORD on, flags are added
NEVER_ENDS, ABBREVIATED, ABBREVIATED_LONG, NO_WORD, SMALL_LETTER, LETTER, HEADING, ORDINAL, FOUR_DIGITS, DIGITS = range(10)
WORD = 10  # + length (0 to 2, 3, more) + 3 * whole letters + 6 * ends well + 12 * initials inside + 24 * numbers a heading
WORDS = WORD + 48


def _ends(mark: int, closed: bool, quoted: bool, gap: int, opened: bool, spaced: bool, after: int, word: int) -> bool:
    """The rule for one combination of classes: may a sentence end here?"""
    upper, starts, small = after >= UPPER, after >= UPPER and (after - UPPER) % 2 == 1, after >= UPPER and after - UPPER >= 2
    digit = after in (DIGIT, DIGIT_YEAR, YEAR_ONLY)
    if after == NONE:
        return False  # the end of the text ends its last sentence anyway
    if mark == DANDA:
        return True
    if mark == WIDE:
        return not quoted or gap == EMPTY_LINE
    if mark == EXCLAIM:
        if after == LOWER or (closed and after == CASELESS and gap == NO_GAP):
            return False
        return upper or digit or after == CASELESS or opened
    if mark == ELLIPSIS:
        return upper and gap != NO_GAP and not spaced
    size, letters, well, inside, heading = 0, False, False, False, False
    if word >= WORD:
        w = word - WORD
        size, letters, well, inside, heading = w % 3, w // 3 % 2 == 1, w // 6 % 2 == 1, w // 12 % 2 == 1, w // 24 == 1
    numeral = word in (HEADING, ORDINAL, FOUR_DIGITS, DIGITS)
    long = size == 2 or word == ABBREVIATED_LONG
    if gap == NO_GAP:
        # sentences that follow each other without a blank
        if not upper and not digit:
            return after == CASELESS and (long or word == FOUR_DIGITS)
        if word in (NEVER_ENDS, ABBREVIATED, ABBREVIATED_LONG):
            return False
        if digit and numeral:
            return word == FOUR_DIGITS and after == YEAR_ONLY and not closed
        if digit:
            return (size >= 1 or closed) and (letters or word in (SMALL_LETTER, LETTER)) and after in (DIGIT_YEAR, YEAR_ONLY)
        if numeral and not closed:
            return starts and (small or word == FOUR_DIGITS)
        return (closed or word == NO_WORD or well) and starts and not inside
    if not (upper or digit or after == CASELESS):
        return False
    if closed:
        return True
    if word in (NEVER_ENDS, LETTER, HEADING, ORDINAL) or (digit and word in (ABBREVIATED, ABBREVIATED_LONG)) or heading:
        return False
    if word == SMALL_LETTER:
        return True
    return numeral or long if after == CASELESS else True


def compile_ends() -> np.ndarray:
    """ENDS[mark, closed, quoted, gap, opened, spaced, after, word]."""
    shape = (5, 2, 2, 3, 2, 2, NEXTS, WORDS)
    return np.array([_ends(m, bool(c), bool(q), g, bool(o), bool(s), n, w) for m, c, q, g, o, s, n, w in np.ndindex(*shape)], bool).reshape(shape)


ENDS = compile_ends()


def _caseless(c: str) -> bool:
    return c.isalpha() and c.lower() == c.upper()


def _mark_class(mark: str) -> int:
    if mark[-1] in "。！？":
        return WIDE
    if mark[-1] in "।॥":
        return DANDA
    if mark[-1] in "!?":
        return EXCLAIM
    return ELLIPSIS if mark.endswith("…") or mark.endswith("..") else PERIOD


def _next_class(opening: str, c: str, c2: str, c3: str, c4: str, c5: str) -> int:
    if not c:
        return NONE
    if c.isupper() or c.istitle() or (c.islower() and c2.isupper()):
        starts = c2.islower() or c.islower() or c2 == "" or not (c2.isalpha() or c2 == ".") or bool(opening)
        return UPPER + starts + 2 * c2.islower()
    if c.islower():
        return LOWER
    if c.isdigit():
        if not (c4 and (c + c2 + c3 + c4).isdigit()):
            return DIGIT
        return YEAR_ONLY if c5 == "" else DIGIT_YEAR if not c5.isdigit() and c5 not in ".,%" else DIGIT
    return CASELESS if _caseless(c) else OTHER


def _word_class(text: str, at: int) -> int:
    """Class of the word that ends at ``at``."""
    tok = _LEFT.search(text, max(0, at - 40), at).group()
    low = tok.lower().lstrip("-")
    if low in NEVER:
        return NEVER_ENDS
    if low in BEFORE_DIGIT:
        return ABBREVIATED_LONG if len(low) > 3 else ABBREVIATED
    if not tok:
        return NO_WORD
    if len(tok) == 1 and tok.isalpha():
        return SMALL_LETTER if tok.islower() and tok in SMALL_END else LETTER
    begin = at - len(tok)
    if tok.isdigit():
        before = text[max(0, begin - 24) : begin]
        line = before.rsplit("\n", 1)[-1]
        if not line.strip() and ("\n" in before or begin - 24 <= 0) and len(tok) <= 3:
            return HEADING  # number of a heading or list item
        if len(tok) <= 2:
            w = _LAST_WORD.search(before)
            if w and w.group(1).lower() in ORDINAL_AFTER:
                return ORDINAL
        return FOUR_DIGITS if len(tok) == 4 else DIGITS
    heading = begin <= 2 and bool(_DOTTED.fullmatch(tok)) and not text[max(0, begin - 2) : begin].strip(" ")
    inside = "." in tok.rstrip(".") and len(tok.rsplit(".", 1)[-1]) == 1
    well = len(tok) > 1 and (tok[-1].islower() or tok[-1].isdigit())
    size = 0 if len(low) <= 2 else 1 if len(low) == 3 else 2
    return WORD + size + 3 * low.isalpha() + 6 * well + 12 * inside + 24 * heading


def _may_end(text: str, at: int, end: int, after: int, mark: int, word: int) -> bool:
    """Whether a sentence may end at ``after``: text[at:end] are terminators, text[end:after] closing marks."""
    gap, opening, *c = _AHEAD.match(text, after).groups()
    quoted = any(x in "”」』’\"" for x in text[end:after])
    blank = EMPTY_LINE if gap.count("\n") > 1 else GAP if gap else NO_GAP
    spaced = at == 0 or text[at - 1].isspace()
    return ENDS.item(mark, int(after > end), int(quoted), blank, int(bool(opening.strip(" -–—"))), int(spaced), _next_class(opening, *c), word)


def events(text: str, lo: int, hi: int) -> list[re.Match]:
    """Marks and blanks that begin in text[lo:hi]."""
    out = []
    for m in _EVENT.finditer(text, max(0, lo - 1)):
        if m.start() >= hi:
            break
        if m.start() >= lo:
            out.append(m)
    return out


def _paragraph(t: str) -> bool:
    return t.isspace() and t.count("\n") > 1


def closing(found: list[re.Match]) -> tuple[bool, int]:
    """(keep, add) of a chunk: the marks that close before its first empty line, and whether it has none, so later ones count too."""
    add = 0
    for m in found:
        t = m.group()
        if _paragraph(t):
            return False, add
        add |= _BIT.get(t[0], 0)
    return True, add


def scan_back(functions: list[tuple[bool, int]]) -> list[int]:
    """Closing marks that come after each chunk in its paragraph, by a suffix scan that doubles its reach."""
    keep = np.array([k for k, _ in functions], bool)
    add = np.array([a for _, a in functions], np.int64)
    reach = 1
    while reach < len(keep):
        k, a = keep.copy(), add.copy()
        a[:-reach] |= np.where(keep[:-reach], add[reach:], 0)  # earlier after later
        k[:-reach] &= keep[reach:]
        keep, add, reach = k, a, reach * 2
    return [*add[1:].tolist(), 0]


def lex(text: str, lo: int = 0, hi: int | None = None, later: int = 0, found: list[re.Match] | None = None) -> tuple[list[int], list[int]]:
    """(positions, symbols) of the events that begin in text[lo:hi]; positions are where a sentence would end.

    ``later``: the closing marks that come after ``hi`` in the same paragraph.
    """
    hi = len(text) if hi is None else hi
    found = events(text, lo, hi) if found is None else found
    waiting = [0] * len(found)
    for i in range(len(found) - 1, -1, -1):
        waiting[i] = later
        t = found[i].group()
        later = 0 if _paragraph(t) else later | _BIT.get(t[0], 0)
    pos: list[int] = []
    sym: list[int] = []
    for m, rest in zip(found, waiting):
        a, e = m.span()
        t = m.group()
        c = t[0]
        closes_later = lambda marks: any(rest & _BIT[x] for x in marks)  # noqa: B023, E731
        if _paragraph(t):
            pos.append(a)
            sym.append(PARAGRAPH)
        elif c.isspace():
            if c != "\n":
                pos.append(a)
                sym.append(END)
        elif c in ".!?…。！？।॥":
            mark = _mark_class(t)
            word = _word_class(text, a) if mark == PERIOD else NO_WORD
            if _may_end(text, a, e, e, mark, word):
                pos.append(e)
                sym.append(END)
            # closing marks that follow at once; a quotation mark after a blank closes in French
            k = e
            while k < len(text):
                if text[k] in _CLOSERS:
                    k += 1
                elif text[k] in " \xa0\u202f" and text[k + 1 : k + 2] == "»":
                    k += 2
                else:
                    break
                if _may_end(text, a, e, k, mark, word):
                    # after the marks themselves have been read
                    pos.append(k)
                    sym.append(END)
        else:
            s = None
            before = text[a - 1] if a else " "
            if c == '"':
                opens = before.isspace() or before in "(["
                s = STRAIGHT if not opens or closes_later('"') else None
                if not opens and not text[e : e + 1].isalpha():
                    s = CLOSE_STRAIGHT
            elif c == "„":
                s = OPEN_LOW if closes_later("“”") else None
            elif c == "“":
                follows = text[e : e + 1]
                closes = not before.isspace() and before not in "：:，,（(" and not follows.isalnum()
                s = CLOSE_HIGH if closes else (DUAL if closes_later("”") or not before.isspace() else None)
            elif c == "”":
                s = CLOSE_HIGH
            elif c == "«":
                s = OPEN_ANGLE if closes_later("»") else None
            elif c == "»":
                s = CLOSE_ANGLE
            elif c in "「『":
                s = OPEN_CORNER if closes_later("」』") else None
            elif c in "」』":
                s = CLOSE_CORNER
            elif c in "([（":
                s = OPEN_PAREN if closes_later(")" if c == "(" else "]" if c == "[" else "）)") else None
            elif c in ")]）":
                s = CLOSE_PAREN
            if s is not None:
                pos.append(a)
                sym.append(s)
    order = sorted(range(len(pos)), key=lambda i: (pos[i], sym[i] != END, i))
    return [pos[i] for i in order], [sym[i] for i in order]


def transitions(sym: list[int]) -> np.ndarray:
    """End state of a chunk for every start state."""
    f = np.arange(STATES, dtype=np.int8)
    for s in sym:
        if s != END:
            f = STEP[f, s]
    return f


def scan(functions: np.ndarray) -> np.ndarray:
    """Start state of each chunk from the chunks' functions, by a prefix scan that doubles its reach."""
    f = functions.copy()
    reach = 1
    while reach < len(f):
        g = f.copy()
        g[reach:] = np.take_along_axis(f[reach:], f[:-reach], 1)  # later after earlier
        f = g
        reach *= 2
    return np.append(np.int8(0), f[:-1, 0])


def emitted(pos: list[int], sym: list[int], state: int) -> list[int]:
    out = []
    for p, s in zip(pos, sym):
        if EMIT[state, s]:
            out.append(p)
        state = STEP[state, s]
    return out


def spans(text: str, ends: list[int]) -> list[tuple[int, int]]:
    """Sentences without surrounding white space between the given ends."""
    out = []
    a = 0
    for e in [*ends, len(text)]:
        part = text[a:e]
        body = part.strip()
        if body:
            s = a + len(part) - len(part.lstrip())
            out.append((s, s + len(body)))
        a = e
    return out


def boundary(text: str, at: int) -> int:
    """The first place from ``at`` on inside a word or number, where no mark or blank is cut; ``at`` itself if there is none near."""
    for p in range(max(at, 1), min(at + MOVE, len(text))):
        if text[p - 1].isalnum() and text[p].isalnum():
            return p
    return min(at, len(text))


def split_text(text: str, chunk: int = CHUNK) -> list[tuple[int, int]]:
    """(start, end) of the sentences of one text, chunk by chunk."""
    edges = [0, *(boundary(text, a) for a in range(chunk, len(text), chunk)), len(text)]
    found = [events(text, a, b) for a, b in zip(edges, edges[1:])]
    later = scan_back([closing(f) for f in found])
    lexed = [lex(text, a, b, m, f) for a, b, m, f in zip(edges, edges[1:], later, found)]
    starts = scan(np.array([transitions(s) for _, s in lexed])) if len(lexed) > 1 else [0]
    return spans(text, [p for (pos, sym), s in zip(lexed, starts) for p in emitted(pos, sym, int(s))])


def _short(id_col: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, no, a, b = [], [], [], []
            for i, t in zip(pdf["id"], pdf["text"]):
                for n, (s, e) in enumerate(split_text(t), 1):
                    ids.append(i)
                    no.append(n)
                    a.append(s)
                    b.append(e)
            yield pd.DataFrame({"id": pd.Series(ids, dtype=pdf["id"].dtype), "sent_no": pd.Series(no, dtype="int32"), "char_start": pd.Series(a, dtype="int32"), "char_end": pd.Series(b, dtype="int32")})

    return run


def _edges(off: int, lead: int, n: int, part: str) -> tuple[int, int]:
    """Begin and end of a chunk in its part of the text, moved into words as its neighbours move them."""
    return boundary(part, lead) if off else 0, boundary(part, lead + n) if lead + n < len(part) else len(part)


def _functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Backward function of each chunk."""
    for pdf in batches:
        f = [closing(events(part, *_edges(off, lead, n, part))) for off, lead, n, part in zip(pdf["off"], pdf["lead"], pdf["n"], pdf["part"])]
        yield pd.DataFrame({"id": pdf["id"], "chunk": pdf["chunk"], "keep": [k for k, _ in f], "add": [a for _, a in f]})


def _later(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk")
    return pd.DataFrame({"id": pdf["id"], "chunk": pdf["chunk"], "later": scan_back(list(zip(pdf["keep"], pdf["add"])))})


def _transitions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Symbols and forward function of each chunk, and its runs of characters between places where a sentence may end."""
    for pdf in batches:
        rows = []
        for i, no, off, lead, n, part, later in zip(pdf["id"], pdf["chunk"], pdf["off"], pdf["lead"], pdf["n"], pdf["part"], pdf["later"]):
            lo, hi = _edges(off, lead, n, part)
            pos, sym = lex(part, lo, hi, int(later))
            base = off - lead
            cuts = sorted({lo, hi, *(min(max(p, lo), hi) for p, s in zip(pos, sym) if s in (END, PARAGRAPH))})
            pieces = []
            for a, e in zip(cuts, cuts[1:]):
                body = part[a:e].strip()
                if body:
                    s = a + len(part[a:e]) - len(part[a:e].lstrip())
                    pieces.append((base + s, base + s + len(body)))
            rows.append((i, no, [base + p for p in pos], sym, [a for a, _ in pieces], [b for _, b in pieces], transitions(sym).tolist()))
        yield pd.DataFrame(rows, columns=["id", "chunk", "pos", "sym", "starts", "ends", "step"])


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk")
    return pd.DataFrame({"id": pdf["id"], "chunk": pdf["chunk"], "state": scan(np.array(pdf["step"].tolist(), np.int8)).astype(np.int32)})


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, chunk, group, a, b, cuts): runs of each chunk with the number of ends before them in the chunk, and all its ends."""
    for pdf in batches:
        rows = []
        for i, no, pos, sym, starts, ends, state in zip(pdf["id"], pdf["chunk"], pdf["pos"], pdf["sym"], pdf["starts"], pdf["ends"], pdf["state"]):
            cuts = np.unique(np.array(emitted(list(pos), list(sym), int(state)), np.int64))
            group = np.searchsorted(cuts, np.asarray(starts, np.int64), side="right")
            rows += [(i, no, int(g), int(a), int(b), len(cuts)) for g, a, b in zip(group, starts, ends)] or [(i, no, None, None, None, len(cuts))]
        yield pd.DataFrame(rows, columns=["id", "chunk", "group", "a", "b", "cuts"]).astype({"group": "Int64", "a": "Int64", "b": "Int64"})


def sentences(df: DataFrame, id_col: str, text: str, long: int = LONG) -> DataFrame:
    """(id_col, sent_no, char_start, char_end): the sentences of every text, in code points, end exclusive.

    NULL, empty and blank texts give no row. Texts longer than ``long`` code
    points are spread over tasks, with the same result as in one; of such a text
    only its chunks' functions and counts come together. Rows that repeat an id
    must not be given; ids that are NULL are left out. Other columns are ignored.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")
    kind = src.schema["id"].dataType.simpleString()
    out = f"id {kind}, sent_no int, char_start int, char_end int"
    short = src.where(F.length("text") <= long).mapInPandas(_short(id_col), out)
    # Spark's strings are UTF-8: length and substring count code points
    cut = src.where(F.length("text") > long).withColumn("c", F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / long).cast("int") - 1)))
    off = F.col("c") * long
    lead = F.least(off, F.lit(BEFORE))
    parts = cut.select("id", F.col("c").alias("chunk"), off.alias("off"), lead.alias("lead"), F.least(F.lit(long), F.length("text") - off).alias("n"), F.substring("text", off - lead + 1, lead + long + AFTER).alias("part"))
    parts = parts.repartition(F.col("id"), F.col("chunk"))
    back = parts.mapInPandas(_functions, f"id {kind}, chunk int, keep boolean, add long").groupBy("id").applyInPandas(_later, f"id {kind}, chunk int, later long")
    lexed = parts.join(back, ["id", "chunk"]).mapInPandas(_transitions, f"id {kind}, chunk int, pos array<long>, sym array<int>, starts array<long>, ends array<long>, step array<int>")
    states = lexed.select("id", "chunk", "step").groupBy("id").applyInPandas(_starts, f"id {kind}, chunk int, state int")
    runs = lexed.join(states, ["id", "chunk"]).mapInPandas(_emit, f"id {kind}, chunk int, group long, a long, b long, cuts int")
    # ends before a chunk number the sentences through the text
    ends = runs.groupBy("id", "chunk").agg(F.max("cuts").alias("cuts"))
    before = ends.select("id", "chunk", F.coalesce(F.sum("cuts").over(Window.partitionBy("id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    spread = runs.where("group is not null").join(before, ["id", "chunk"]).groupBy("id", (F.col("group") + F.col("before")).alias("g")).agg(F.min("a").cast("int").alias("char_start"), F.max("b").cast("int").alias("char_end"))
    spread = spread.withColumn("sent_no", F.row_number().over(Window.partitionBy("id").orderBy("g"))).select("id", "sent_no", "char_start", "char_end")
    return short.unionByName(spread).withColumnRenamed("id", id_col)
