"""Personal data by candidate gradient boosting, with DataFrame and SQL functions only.

1. Base patterns give spans that are always kept where their checks hold.
2. High-recall generators propose more spans, which may overlap: numbers and telephone numbers inside longer runs
   that a base pattern swallowed whole, spelt-out addresses, bounded dotted quads, and for keys, tokens and passwords
   (``secret``, which no base pattern has) every run of 16 characters and more without a gap that has a letter, words among them.
3. Every span is described by small numbers (format and context). Counts of all spans by these numbers, over all
   documents, are a table whose size is bounded by the product of their ranges. Boosted trees are fitted on it and
   become one SQL expression. Nobody labelled spans; the weak label is a check that the features don't contain: the
   check digit of a card (a number of another kind passes one time in ten), the range of the parts of an IP address,
   the ending of an address, the structure of a telephone number, a secret's changes between digits and letters. So the trees learn in which formats and contexts
   spans are what they look like.
4. Per kind, the threshold is the lowest score at which the proposed spans of the held-out fold have the wanted share
   of likely ones; base spans, which stay anyway, don't count there. A proposed span is added if its check holds, its
   score is above the threshold and it touches no base span (a secret may have one inside). Secrets have no check: there the score alone decides, so a
   password of letters is added where one is assigned, and a digest of a file without such words before it is not.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendon.llm.shared import id_crc, saved, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
ROUNDS = 40
RATE = 0.3
DEPTH = 3
PRECISION = 0.9
#: Spans whose lengths are summed together, so that places take no second look at all spans before.
RUN = 128
#: Words before a span that hint at each kind.
CUES = {
    "email": "e-?mail|mail|contact|write|reach",
    "ip": "ip|host|server|address|node|ping",
    "card": "card|visa|amex|mastercard|account|pay|paid|payment|charge|billing",
    "phone": "call|phone|tel|telephone|fax|mobile|cell|whatsapp|ring",
    "secret": "token|secret|password|passwd|pwd|key|apikey|api-key|credential|bearer|auth|authorization",
}

# name -> (kind, generator is a base pattern, cheap test of the text, pattern). Possessive parts and the bounds before
# them keep the leftmost matches of the plain patterns but need no second look at a run of characters.
GENERATORS: dict[str, tuple[str, bool, str, str]] = {
    "email": ("email", True, "contains(text, '@')", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ("ip", True, r"text rlike '[0-9]\\.[0-9]'", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"),
    "card": ("card", True, "text rlike '[0-9](?:[ -]?[0-9]){15}'", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"),
    "phone": ("phone", True, "contains(text, '+')", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "spelt": ("email", False, r"text rlike '(?i)[\\[(] ?at ?[\\])]'", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[a-z0-9-]{1,63}+(?: ?[\[(] ?dot ?[\])] ?[a-z0-9-]{1,63}+)++"),
    "quad": ("ip", False, r"text rlike '[0-9]\\.[0-9]'", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])"),
    "number": ("card", False, "text rlike '[0-9](?:[ -]?[0-9]){12}'", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])"),
    "call": ("phone", False, "contains(text, '+')", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])"),
    "opaque": ("secret", False, "text rlike '[A-Za-z0-9+/_-]{16}'", r"(?<![A-Za-z0-9+/_-])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}"),
}

_LAST_WORD = r"(?i)([a-z-]+)[^a-z0-9]*$"


def _cue_words() -> str:
    kinds = " ".join(f"when x.cue rlike '^(?:{words})s?$' then '{kind}'" for kind, words in CUES.items())
    return f"case {kinds} end"


#: Features of a span: name -> (numbers of values, expression over the span x). Values are 0 up to that number.
FEATURES: dict[str, tuple[int, str]] = {
    "kind_no": (5, "array_position(array('email', 'ip', 'card', 'phone', 'secret'), x.kind) - 1"),
    "digits": (5, "case when x.kind in ('email', 'phone', 'secret') then 0 when x.n_digits < 8 then 1 when x.n_digits < 16 then 2 when x.n_digits < 17 then 3 else 4 end"),
    "breaks": (4, r"least(3, length(regexp_replace(x.found, '[^ ()-]', '')))"),
    "left": (4, r"case when x.before = '' or x.before rlike '\\n$' then 0 when x.before rlike '[0-9]\\s$' then 3 when x.before rlike '[\\p{L}\\p{N}]$' then 2 else 1 end"),
    "right": (4, r"case when x.after = '' or x.after rlike '^\\n' then 0 when x.after rlike '^\\s[0-9]' then 3 when x.after rlike '^[\\p{L}\\p{N}]' then 2 else 1 end"),
    "cue": (3, f"case coalesce({_cue_words()}, '') when x.kind then 2 when '' then 0 else 1 end"),
    "sign": (3, r"case when x.before rlike '[:=][^A-Za-z0-9]{0,6}$' then 2 when x.before rlike '[\"\'(<]$' then 1 else 0 end"),
    "lead": (3, "case when x.kind <> 'card' then 0 when left(x.d, 1) in ('3', '4', '5', '6') then 1 else 2 end"),
    "source": (2, "int(x.base)"),
}

_LUHN = """aggregate(sequence(1, length(d)), 0, (a, i) -> a + case when i % 2 = 1 then int(substr(d, -i, 1))
    else 2 * int(substr(d, -i, 1)) - if(int(substr(d, -i, 1)) > 4, 9, 0) end) % 10 = 0"""


def _sound(kind: str) -> str:
    """Whether the found text of a kind passes its check; ``d`` has its digits."""
    if kind == "ip":
        return r"forall(split(found, '\\.'), o -> length(regexp_replace(o, '^0+', '')) <= 3 and int(concat('0', right(o, 3))) <= 255)"
    if kind == "card":
        return f"length(d) between 13 and 19 and {_LUHN}"
    if kind == "phone":
        return "length(d) between 8 and 15"
    return "true"


def _likely(kind: str) -> str:
    """The weak label of a found text: its check, and what else the features of its kind don't tell."""
    if kind == "email":
        return "found rlike '(?i)[.\\\\]) ][a-z]{2,12}$'"
    if kind == "secret":  # by what it looks like, while the features only tell where it stands
        return "found rlike '(?:[0-9]{1,8}[A-Za-z]{1,8}[^A-Za-z0-9]{0,2}){3}'"
    if kind == "phone":
        return f"{_sound(kind)} and found rlike {_quoted('^' + GENERATORS['call'][3] + '$')}"
    return _sound(kind)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def candidates(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)``: all spans of all generators, base ones marked, with their features.

    Positions are code points. A null text counts as empty; ids may be null or repeat.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    for name, (_, _, test, pattern) in GENERATORS.items():
        q = _quoted(pattern)
        rows = rows.withColumn(f"m_{name}", F.expr(f"if({test}, regexp_extract_all(text, {q}, 0), array())"))
        rows = rows.withColumn(f"p_{name}", F.expr(f"if(size(m_{name}) > 0, split(text, {q}, -1), array())"))
    every = []
    for name, (kind, base, _, _) in GENERATORS.items():
        m, p, n, r = (f"{x}_{name}" for x in "mpnr")
        rows = rows.withColumn(n, F.expr(f"transform({m}, (y, i) -> bigint(length(y) + length(get({p}, i))))"))
        rows = rows.withColumn(r, F.expr(f"if(size({m}) > 0, transform(sequence(0, (size({m}) - 1) div {RUN}), b -> aggregate(slice({n}, int(b * {RUN} + 1), {RUN}), 0L, (a, y) -> a + y)), array())"))
        start = (
            f"aggregate(slice({r}, 1, int(i div {RUN})), 0L, (a, y) -> a + y) + aggregate(slice({n}, int(i div {RUN}) * {RUN} + 1, i % {RUN}), 0L, (a, y) -> a + y)"
            f" + length(get({p}, i))"
        )
        every.append(
            f"transform({m}, (found, i) -> named_struct('kind', '{kind}', 'base', {str(base).lower()}, 'start', {start}, 'found', found,"
            f" 'before', right(concat(coalesce(get({m}, i - 1), ''), get({p}, i)), 24), 'after', left(concat(get({p}, i + 1), coalesce(get({m}, i + 1), '')), 2),"
            f" 'd', regexp_replace(found, '[^0-9]', '')))"
        )
    rows = rows.select("doc_id", F.expr(f"concat({', '.join(every)})").alias("spans"))
    own = lambda check: check.replace("found", "x.found").replace("(d)", "(x.d)").replace("(d,", "(x.d,")
    checks, labels = (" ".join(f"when x.kind = '{k}' then {own(of(k))}" for k in KINDS) for of in (_sound, _likely))
    cue = f"lower(regexp_extract(x.before, {_quoted(_LAST_WORD)}, 1))"
    rows = rows.withColumn("spans", F.expr(
        "transform(spans, x -> named_struct('kind', x.kind, 'base', x.base, 'start', x.start, 'end', x.start + length(x.found),"
        f" 'found', x.found, 'before', x.before, 'after', x.after, 'd', x.d, 'n_digits', length(x.d), 'cue', {cue}, 'sound', case {checks} end, 'likely', case {labels} end))"
    ))
    parts = ", ".join(f"'{f}', int({e})" for f, (_, e) in FEATURES.items())
    # a base span of a card has 16 digits or more
    keep = "x.base and x.sound and (x.kind <> 'card' or x.n_digits >= 16)"
    return rows.select("doc_id", F.expr(
        f"transform(spans, x -> named_struct('kind', x.kind, 'base', {keep}, 'tried', x.base, 'sound', x.sound, 'likely', x.likely, 'start', x.start, 'end', x.end, {parts}))"
    ).alias("spans"))


Cell = tuple[tuple[int, ...], float, float]  # features, weight of label 1, weight of label 0


def boosted(cells: list[Cell], rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list[tuple]]:
    """Start value and trees of depth DEPTH of logistic boosting over weighted cells.

    A tree is ``(feature, at, low, high)``: below ``at`` or not, where low and high are values or such tuples.
    """
    x = np.array([c[0] for c in cells], np.int64).reshape(len(cells), len(FEATURES))
    one, zero = (np.array([c[k] for c in cells], float) for k in (1, 2))
    start = math.log((one.sum() + 0.5) / (zero.sum() + 0.5))
    score = np.full(len(cells), start)
    splits = [(f, at) for f, (n, _) in enumerate(FEATURES.values()) for at in range(1, n)]
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = one * (1 - p) - zero * p, (one + zero) * p * (1 - p)

        def grow(rows: np.ndarray, depth: int):
            total_g, total_h = g[rows].sum(), h[rows].sum()  # noqa: B023
            top = None
            for f, at in splits if depth else []:
                low = rows & (x[:, f] < at)
                low_g, low_h = g[low].sum(), h[low].sum()  # noqa: B023
                if low_h < 1e-9 or total_h - low_h < 1e-9:
                    continue
                gain = low_g**2 / (low_h + 1) + (total_g - low_g) ** 2 / (total_h - low_h + 1) - total_g**2 / (total_h + 1)
                if gain > 1e-6 and (top is None or gain > top[0]):
                    top = gain, f, at
            if top is None:
                return float(rate * total_g / (total_h + 1))
            _, f, at = top
            return f, at, grow(rows & (x[:, f] < at), depth - 1), grow(rows & (x[:, f] >= at), depth - 1)

        tree = grow(np.ones(len(cells), bool), DEPTH)
        trees.append(tree)
        score = score + np.array([value(tree, c[0]) for c in cells])
    return start, trees


def value(tree, features: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] < tree[1] else tree[3]
    return tree


def expression(start: float, trees: list) -> str:
    """The boosted score of a span ``x`` as SQL."""
    names = list(FEATURES)

    def of(tree) -> str:
        if not isinstance(tree, tuple):
            return f"{tree!r}D"
        return f"if(x.{names[tree[0]]} < {tree[1]}, {of(tree[2])}, {of(tree[3])})"

    return " + ".join([f"{start!r}D", *(of(t) for t in trees)])


def thresholds(cells: list[Cell], start: float, trees: list, precision: float = PRECISION) -> dict[str, float]:
    """Per kind, the score from which on the cells have the wanted precision; infinite without any.

    It lies halfway between the last score that is let in and the first that isn't.
    """
    out = {}
    for no, kind in enumerate(KINDS):
        own = sorted(((start + sum(value(t, c[0]) for t in trees), c[1], c[2]) for c in cells if c[0][0] == no), reverse=True)
        ones = zeros = 0.0
        out[kind] = math.inf
        for i, (score, one, zero) in enumerate(own):
            ones, zeros = ones + one, zeros + zero
            last = i + 1 == len(own) or own[i + 1][0] != score
            if last and ones and ones / (ones + zeros) >= precision:
                out[kind] = score if i + 1 == len(own) else (score + own[i + 1][0]) / 2
    return out


def model(rows: DataFrame) -> tuple[float, list, dict[str, float]]:
    """The trees and the thresholds, from all spans of ``candidates``.

    One in five ids calibrates, the others fit. What is collected is bounded by the product of the features' ranges,
    whatever the number of documents.
    """
    names = list(FEATURES)
    one = rows.select((id_crc() % 5 == 0).alias("calibrates"), F.explode("spans").alias("x"))
    counts = one.groupBy("calibrates", *(F.col(f"x.{n}").alias(n) for n in names)).agg(
        F.sum(F.col("x.likely").cast("double")).alias("ones"), F.count(F.lit(1)).alias("n")
    )
    cells: dict[bool, list[Cell]] = {True: [], False: []}
    for r in sorted(counts.collect(), key=tuple):
        cells[r["calibrates"]].append((tuple(r[n] for n in names), r["ones"], r["n"] - r["ones"]))
    start, trees = boosted(cells[False])
    source = list(FEATURES).index("source")
    return start, trees, thresholds([c for c in cells[True] if not c[0][source]], start, trees)


def found(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, spans)`` per input row: arrays of ``(kind, start, end)``, by kind as in KINDS, then by start.

    ``spans`` has the base spans and those that the boosted trees add. A null or empty text has none. Null and
    repeated ids are rows like any other; other columns are ignored; an empty table gives an empty result.
    """
    rows = saved(candidates(docs), "pii-candidates")
    start, trees, limits = model(rows)
    score = expression(start, trees)
    limit = " ".join(f"when x.kind = '{k}' then {'double(\"Infinity\")' if math.isinf(v) else f'{v - 1e-9!r}D'}" for k, v in limits.items())
    rows = rows.withColumn("base", F.expr("filter(spans, x -> x.base)"))
    rows = rows.withColumn("more", F.expr(
        f"filter(spans, x -> not x.tried and x.sound and ({score}) >= case {limit} end and not exists(base, b -> b.start < x.end and x.start < b.end"
        " and not (x.kind = 'secret' and x.start <= b.start and b.end <= x.end and b.end - b.start < x.end - x.start)))"
    ))
    slim = "x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end)"
    in_order = lambda a: "concat(" + ", ".join(f"array_sort(transform(filter({a}, x -> x.kind = '{k}'), {slim}))" for k in KINDS) + ")"
    return rows.select("doc_id", F.expr(in_order("base")).alias("base"), F.expr(in_order("concat(base, more)")).alias("spans"))


def listed(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; of overlapping spans the first
    one counts, of those with one start the longest.

    Spans are found per text, so rows with equal texts are treated alike; null texts stay null.
    """
    names = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc_id"), F.col("text"))
    rows = found(packed)
    fold = """aggregate(array_sort(transform(spans, x -> named_struct('start', x.start, 'back', -x.end, 'end', x.end, 'kind', x.kind))),
        named_struct('out', '', 'at', 0L),
        (a, x) -> if(x.start < a.at, a, named_struct('out', concat(a.out, substr(doc_id.text, int(a.at) + 1, int(x.start - a.at)), '[', upper(x.kind), ']'), 'at', x.end)),
        a -> concat(a.out, substr(doc_id.text, int(a.at) + 1)))"""
    rows = rows.withColumn("clean", F.expr(f"if(doc_id.text is null, null, {fold})"))
    return rows.select(*(F.col("clean").alias(c) if c == "text" else F.col("doc_id").getField(c).alias(c) for c in names))
