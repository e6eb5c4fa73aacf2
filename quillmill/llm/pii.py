"""Personal data: rules, wider generators, and boosted trees over their candidates, in SQL functions only.

The base rules find e-mail addresses, IPv4 addresses, payment cards and phone
numbers. Their spans are masked, and generators propose overlapping spans in
what is left: spelled-out and defanged addresses, cards that a longer run of
digits hides from the rule, numbers without a country code, and many runs of
digits that are nothing of the kind. Boosted trees judge a candidate by its
format and its context, never by the exact test of its kind (Luhn's test,
octets, lengths): that test is the evidence they learn from. Of the corpus,
spans that a rule confirms are positive, and candidates that fail the test and
touch no rule's span negative. ``SEEDS`` adds labelled phrases in which
the same numbers are personal data or not by their context alone. The four
groups weigh the same, whatever the size of the corpus. A quarter of each is
held out to calibrate the score from which a kind's candidates are taken. A
candidate is added if its score reaches that threshold, its exact test holds,
and no better one overlaps it.

Trees become IF expressions, so rows never leave the JVM. Positions are code
points. Where a pattern matches is found by splitting the text at the matches:
lengths of pieces and matches add up to positions. Sums over matches and
replacements go in runs of RUN, so the work grows about with the length of a
text, however many matches it has.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release_driver

KINDS = ("email", "ip", "card", "phone")

#: The base rules, with possessive loops, so that Java's matcher neither recurses nor tries a run again from its middle.
#: ``\G`` lets a match begin within a run right after the last match, as the plain rule does.
_RULE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a rule of a kind to have a chance.
_RULE_GUARD = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
#: The same for the generators.
_GUARD = {
    "email": r"@|[\[(](?:at|AT)[\])]| (?:dot|DOT) ",
    "ip": r"[0-9](?:\.|[\[(]\.[\])]| ?[\[(](?:dot|DOT)[\])] ?)[0-9]",
    "card": r"[0-9](?:[ .-]?[0-9]){12}",
    "phone": r"[0-9](?:[ ().-]{0,2}[0-9]){6}",
}
_USER, _LABEL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}", "[A-Za-z0-9-]{1,63}"
_GENERATORS = {
    "email": (
        rf"{_USER}(?:@| ?[\[(](?:at|AT)[\])] ?){_LABEL}(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?){_LABEL}){{0,5}}",
        rf"{_USER} (?:at|AT) {_LABEL}(?: (?:dot|DOT) {_LABEL}){{1,4}}",
    ),
    "ip": (r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|[\[(]\.[\])]| ?[\[(](?:dot|DOT)[\])] ?)[0-9]{1,3}){3}(?![0-9])",),
    "card": (
        r"(?<![0-9])[0-9]{13,19}(?![0-9])",
        r"(?<![0-9])[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
        r"(?<![0-9])[0-9]{4}([ .-])[0-9]{6}\1[0-9]{4,5}(?![0-9])",
    ),
    "phone": (
        r"\+[0-9]{1,3}[ .-]?(?:\(0?\) ?)?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
        r"(?<![0-9+.-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])[0-9]{2,5}(?:[ .-][0-9]{2,5}){1,3}(?![0-9])",
        r"(?<![0-9+.-])[0-9]{7,14}(?![0-9])",
    ),
}
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Words before a span that speak for its kind.
_WORDS = {
    "email": "mail|contact|write to|reach|escri|correo|schreib|courriel|écri",
    "ip": r"\bip|host|server|address|adress|direcci|login|connect|ping",
    "card": "card|visa|master|amex|credit|debit|karte|tarjeta|carte|pago|charge",
    "phone": r"\btel|phone|call|mobile|cell|\bfax|anruf|handy|llam|móvil|appel|portable|sms|dial|whatsapp",
}
#: Words before a span that speak for another sort of number.
_OTHER = r"order|invoice|\bref|serial|sku|isbn|issn|\bean\b|tracking|version|\bver\b|\bv$|release|build|part|item|model|section|chapter|figure|\bid\b|\bno\b|token|hash|total|score|\bbestell|rechnung|pedido|factura|facture|commande|article|abschnitt|capítulo|population|year|price|\beur|\busd|[$€£#=]"
FEATURES = {
    "form": tuple(range(5)), "size": tuple(range(6)), "marks": tuple(range(4)), "lead": tuple(range(4)), "varied": (0, 1),
    "before": (0, 1, 2), "after": (0, 1, 2), "named": tuple(range(4)), "crowd": (0, 1, 2),
}
CONTEXT = ("before", "after", "named", "crowd")  # the other features are of format
AROUND = 32  # characters on either side that are context
PRECISION = 0.97
TREES, DEPTH, RATE = 24, 3, 0.4
GROUP_WEIGHT = 200.0  # of each of the four groups of examples: corpus and seeds, positive and negative
LEAST = 50  # a group of the corpus with fewer examples has less weight: GROUP_WEIGHT / LEAST for each
RUN = 256
_MASK = "\u0001"

#: Phrases that hold a number (or address) of a kind at ``{}``: personal data, and not.
SEEDS = {
    "email": (
        ("mail me: {}", "contact {} for more", "write to {} today", "escribe a {}", "Schreib an {}", "{} is my address", "or by mail ({})", "reach us, {}"),
        ("total {}", "version {}", "the item {} was", "look {} it", "order {}", "ref={}", "x/{}/y", "stay {} the"),
    ),
    "ip": (
        ("ip {}", "from host {} at", "the server {} went", "login from {}", "Adresse {}", "ping {}", "connect to {}:", "dirección {}", "seen at {} twice", "from {}, then", "({})"),
        ("version {}", "release {} is out", "section {} says", "see chapter {}", "v{}", "build {}", "Abschnitt {}", "1.{}", "order {}-3", "x{}", "{}-rc1", "lib{}b2", "q={}z", "30 17 {} 2024 11 55", "55 1 {} 7004 12 3"),
    ),
    "card": (
        ("card {}", "credit card number: {}", "Visa {} exp 04", "charge {} please", "pay by {} now", "Kreditkarte {}", "tarjeta {}", "carte bancaire : {}", "mastercard {}", "was {} and", "amex: {}"),
        ("order {}", "invoice {}", "tracking {}", "ref. {}", "serial {}", "item {} in stock", "Bestellung {}", "pedido {}", "facture {}", "token=a{}f", "id={}", "x{}y", "{}b", "ISBN {}", "12 77 {} 31 9", "hash d{}e0"),
    ),
    "phone": (
        ("call {}", "tel. {}", "phone: {}", "my mobile is {}", "cell {} or", "fax {}", "Anruf unter {}", "llámame al {}", "appelez le {}", "Handy: {}", "dial {} now", "sms {}", "whatsapp {}"),
        ("order {}", "invoice {}", "part {}", "item {}", "ref {}", "total {}", "population {}", "token {}", "id={}", "x{}z", "Rechnung {}", "article {}", "was {} and", "the {} of", "{}.", "and {}, or", "price {}", "page 12 of {}", "score {}"),
    ),
}
SEED_ROUNDS = 8


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(x: str) -> str:
    """SQL: the digits of ``x`` (no other characters) pass Luhn's test."""
    digit = f"CAST(substr(reverse({x}), i, 1) AS INT)"
    return f"aggregate(sequence(1, length({x})), 0, (s, i) -> s + IF(i % 2 = 1, {digit}, IF({digit} > 4, 2 * {digit} - 9, 2 * {digit}))) % 10 = 0"


def _valid(kind: str, m: str) -> str:
    """SQL: a match of the kind's rule holds."""
    if kind == "ip":
        return f"{m} RLIKE {_q('^' + '[.]'.join([_OCTET] * 4) + '$')}"
    if kind == "card":
        d = f"translate({m}, ' -', '')"
        return f"length({d}) BETWEEN 14 AND 19 AND IF(length({d}) BETWEEN 14 AND 19, {_luhn(d)}, false)"
    if kind == "phone":
        return f"length(translate({m}, ' ().+-', '')) BETWEEN 10 AND 15"
    return "true"


def _holds(kind: str, m: str) -> str:
    """SQL: the exact test of a generator's candidate."""
    if kind == "email":
        return rf"{m} RLIKE {_q(r'[.)\] ][A-Za-z]{2,24}$')} AND {m} RLIKE {_q(r'@|[\[(]|(?:dot|DOT)')}"
    if kind == "ip":
        return _valid("ip", rf"regexp_replace(regexp_replace({m}, {_q(r'[^0-9.]')}, ' '), {_q(r'[ .]+')}, '.')")
    if kind == "card":
        return f"IF(length({_digits(m)}) BETWEEN 13 AND 19, {_luhn(_digits(m))}, false)"
    return f"length({_digits(m)}) BETWEEN 7 AND 15"


def _runs(xs: str) -> str:
    """SQL: the array ``xs`` in runs of RUN."""
    return f"transform(sequence(0, CAST(greatest(size({xs}) - 1, 0) / {RUN} AS INT)), r -> slice({xs}, r * {RUN} + 1, {RUN}))"


def _starts(sizes: str) -> str:
    """SQL: for each of the sizes the sum of those before it."""
    inner = "aggregate(run, named_struct('at', a.at, 'out', CAST(array() AS ARRAY<INT>)), (b, n) -> named_struct('at', b.at + n, 'out', array_append(b.out, b.at)))"
    return (
        f"aggregate({_runs(sizes)}, named_struct('at', 0, 'out', CAST(array() AS ARRAY<ARRAY<INT>>)), "
        f"(a, run) -> {_let(inner, 'now', '''named_struct('at', now.at, 'out', array_append(a.out, now.out))''')}, a -> flatten(a.out))"
    )


def _matches(text: str, pattern: str) -> str:
    """SQL: array of (s, e, m, b, a), start and end in code points, the match, and what stands around it up to the next one, of all matches of ``pattern``."""
    p = _q(pattern)
    found = (
        f"transform(w.m, (m, i) -> named_struct('s', st[i] + length(w.g[i]), 'e', st[i] + length(w.g[i]) + length(m), 'm', m, "
        f"'b', right(w.g[i], {AROUND}), 'a', left(w.g[i + 1], {AROUND})))"
    )
    sizes = _let("transform(w.m, (m, i) -> length(w.g[i]) + length(m))", "sz", _starts("sz"))
    return _let(f"named_struct('m', regexp_extract_all({text}, {p}, 0), 'g', split({text}, {p}, -1))", "w", _let(sizes, "st", found))


_NONE = "CAST(array() AS ARRAY<STRUCT<s: INT, e: INT, m: STRING, b: STRING, a: STRING>>)"


def _base(kind: str, text: str) -> str:
    """SQL: the kind's rule's matches."""
    return f"IF({text} RLIKE {_q(_RULE_GUARD[kind])}, {_matches(text, _RULE[kind])}, {_NONE})"


def _candidates(kind: str, text: str) -> str:
    """SQL: what the kind's generators propose; spans of different generators may overlap."""
    return f"IF({text} RLIKE {_q(_GUARD[kind])}, concat({', '.join(_matches(text, g) for g in _GENERATORS[kind])}), {_NONE})"


def _features(kind: str, x: str) -> str:
    """SQL: the features of a match, and whether its exact test holds."""
    m, d = f"{x}.m", _digits(f"{x}.m")
    n = f"length({d})"
    form = {
        "email": f"CASE WHEN {m} LIKE '%@%.%' THEN 0 WHEN {m} RLIKE {_q(r'[\[(](?:at|AT)')} THEN 1 WHEN {m} LIKE '%@%' THEN 3 ELSE 2 END",
        "ip": f"IF({m} RLIKE '^[0-9.]+$', 0, 1)",
        "card": f"CASE WHEN {m} RLIKE '^[0-9]+$' THEN 0 WHEN {m} LIKE '% %' THEN 1 WHEN {m} LIKE '%-%' THEN 2 ELSE 3 END",
        "phone": f"CASE WHEN {m} LIKE '+%' THEN 0 WHEN {m} LIKE '(%' THEN 1 WHEN {m} LIKE '00%' THEN 2 WHEN {m} RLIKE '^[0-9]+$' THEN 4 ELSE 3 END",
    }[kind]
    size = {
        "email": f"least(CAST(length({m}) / 8 AS INT), 5)",
        "ip": f"greatest(0, least(CAST(({n} - 3) / 2 AS INT), 5))",
        "card": f"CASE {n} WHEN 13 THEN 0 WHEN 14 THEN 1 WHEN 15 THEN 2 WHEN 16 THEN 3 WHEN 19 THEN 5 ELSE 4 END",
        "phone": f"CASE WHEN {n} < 8 THEN 0 WHEN {n} < 10 THEN 1 WHEN {n} = 10 THEN 2 WHEN {n} = 11 THEN 3 WHEN {n} = 12 THEN 4 ELSE 5 END",
    }[kind]
    lead = {
        "email": f"CASE WHEN {m} RLIKE '^[A-Za-z]+[^A-Za-z0-9._%+-]' THEN 0 WHEN {m} RLIKE '^[A-Za-z]' THEN 1 WHEN {m} RLIKE '^[0-9]' THEN 2 ELSE 3 END",
        "ip": f"CASE WHEN {m} LIKE '0%' THEN 0 WHEN {m} RLIKE '^[1-9][^0-9]' THEN 1 WHEN {m} RLIKE '^[0-9]{{2}}[^0-9]' THEN 2 ELSE 3 END",
        "card": f"CASE WHEN {d} LIKE '4%' THEN 0 WHEN {d} RLIKE '^5[1-5]|^2[2-7]' THEN 1 WHEN {d} RLIKE '^3[47]|^6' THEN 2 ELSE 3 END",
        "phone": f"CASE WHEN {d} LIKE '0%' THEN 0 WHEN {d} LIKE '1%' THEN 1 WHEN {d} RLIKE '^[2-9][0-8]' THEN 2 ELSE 3 END",
    }[kind]
    marks = f"least(3, length({m}) - length(translate({m}, {_q('.[]()' if kind in ('email', 'ip') else ' ().-')}, '')))" if kind != "ip" else f"IF({m} RLIKE '(^|[^0-9])0[0-9]', 1, 0)"
    side = "CASE WHEN {0} = '' OR {0} RLIKE '[\\\\s]' THEN 0 WHEN {0} RLIKE '[\\\\p{{L}}\\\\p{{N}}_=/@.+-]' THEN 1 ELSE 2 END"
    near = f"length({_digits(f'{x}.b')}) + length({_digits(f'{x}.a')})"
    fields = {
        "form": form, "size": size, "marks": marks, "lead": lead, "varied": f"IF(size(array_distinct(split({m}, ''))) > 6, 1, 0)",
        "before": side.format(f"right({x}.b, 1)"), "after": side.format(f"left({x}.a, 1)"),
        "named": f"IF(lower({x}.b) RLIKE {_q(_WORDS[kind])}, 1, 0) + IF(lower({x}.b) RLIKE {_q(_OTHER)}, 2, 0)",
        "crowd": f"CASE WHEN {near} = 0 THEN 0 WHEN {near} < 8 THEN 1 ELSE 2 END",
    }
    assert tuple(fields) == tuple(FEATURES)
    listed = ", ".join(f"'{f}', CAST({v} AS INT)" for f, v in fields.items())
    return f"named_struct('k', {_q(kind)}, 's', {x}.s, 'e', {x}.e, 'holds', {_holds(kind, m)}, {listed})"


def _replaced(text: str, spans: str, by: str, rest: str) -> str:
    """SQL: ``text`` with ``spans`` (s, e, k), in order of s, replaced: a span x by ``by``, one that begins within an earlier one by ``rest`` (``at`` is where that ends)."""
    step = (
        f"IF(x.s < b.at, named_struct('at', greatest(b.at, x.e), 'out', array_append(b.out, {rest.format(at='b.at')})), "
        f"named_struct('at', x.e, 'out', array_append(b.out, concat(substr(t, b.at - a.at + 1, x.s - b.at), {by}))))"
    )
    inner = f"aggregate(run, named_struct('at', a.at, 'out', CAST(array() AS ARRAY<STRING>)), (b, x) -> {step})"
    piece = f"substr({text}, a.at + 1, greatest(0, array_max(transform(run, y -> y.e)) - a.at))"
    outer = f"aggregate({_runs(spans)}, named_struct('at', 0, 'out', CAST(array() AS ARRAY<STRING>)), (a, run) -> "
    now = _let(inner, "now", "named_struct('at', now.at, 'out', array_append(a.out, array_join(now.out, '')))")
    return f"IF(size({spans}) = 0, {text}, {outer}{_let(piece, 't', now)}, a -> concat(array_join(a.out, ''), substr({text}, a.at + 1))))"


def _ordered(spans: str) -> str:
    """SQL: spans (k, s, e) by start, then kind as listed."""
    rank = "CASE x.k " + " ".join(f"WHEN {_q(k)} THEN {i}" for i, k in enumerate(KINDS)) + " END"
    return f"transform(array_sort(transform({spans}, x -> named_struct('s', x.s, 'r', {rank}, 'e', x.e, 'k', x.k))), x -> named_struct('k', x.k, 's', x.s, 'e', x.e))"


def _spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_rule``, every kind's rule's matches and whether they hold, ``_base``, the spans of those that do, and ``_masked``, the text without them."""
    rules = []
    for kind in KINDS:
        docs = docs.withColumn(f"_{kind}", F.expr(_base(kind, "text"))).withColumn(f"_{kind}", F.expr(f"transform(_{kind}, x -> named_struct('x', x, 'holds', {_valid(kind, 'x.m')}))"))
        rules.append(f"transform(filter(_{kind}, y -> y.holds), y -> named_struct('k', {_q(kind)}, 's', y.x.s, 'e', y.x.e))")
    docs = docs.withColumn("_base", F.expr(_ordered(f"concat({', '.join(rules)})")))
    return docs.withColumn("_masked", F.expr(_replaced("text", "_base", f"repeat({_q(_MASK)}, x.e - x.s)", f"repeat({_q(_MASK)}, greatest(0, x.e - {{at}}))")))


def _proposed(text: str) -> str:
    """SQL: the candidates of all kinds in ``text`` and their features."""
    return f"concat({', '.join(f'transform({_candidates(kind, text)}, x -> {_features(kind, chr(120))})' for kind in KINDS)})"


def _examples(yes: str, no: str, base: str) -> str:
    """SQL: candidates (y, c) of one text: positive those of ``yes`` that are spans of ``base``, negative those of ``no`` that fail their exact test.

    Spans and candidates are sorted together. A span is once in ``base``, and
    no more often among a kind's candidates than the kind has generators, so
    it stands among the few before an equal candidate.
    """
    both = f"concat(transform({base}, x -> named_struct('s', x.s, 'e', x.e, 'k', x.k, 'i', -1)), transform({yes}, (x, i) -> named_struct('s', x.s, 'e', x.e, 'k', x.k, 'i', i)))"
    before = " OR ".join(f"(i >= {d} AND get(o, i - {d}).i < 0 AND get(o, i - {d}).s = x.s AND get(o, i - {d}).e = x.e AND get(o, i - {d}).k = x.k)" for d in range(1, 1 + max(map(len, _GENERATORS.values()))))
    own = _let(f"array_sort({both})", "o", f"transform(filter(o, (x, i) -> x.i >= 0 AND ({before})), x -> named_struct('y', 1, 'c', get({yes}, x.i)))")
    return f"concat({own}, transform(filter({no}, x -> NOT x.holds), x -> named_struct('y', 0, 'c', x)))"


# ---- boosted trees over counts of feature values ----


def _grow(rows: list[tuple[tuple, float, float]], depth: int):
    """A regression tree on gradients: (feature, value, left, right), or a leaf's weight."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf, best = g / (h + 1.0), (1e-6, None)
    if depth:
        for i, (f, values) in enumerate(FEATURES.items()):
            sums = {v: [0.0, 0.0] for v in values}
            for x, rg, rh in rows:
                s = sums[x[i]]
                s[0] += rg
                s[1] += rh
            gl = hl = 0.0
            for v in values[:-1]:
                gl, hl = gl + sums[v][0], hl + sums[v][1]
                if 0 < hl < h:
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    best = max(best, (gain, (f, v, i)), key=lambda x: x[0])
    if best[1] is None:
        return leaf
    f, v, i = best[1]
    return f, v, _grow([r for r in rows if r[0][i] <= v], depth - 1), _grow([r for r in rows if r[0][i] > v], depth - 1)


def _value(tree, x: dict) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def _sql(tree, x: str) -> str:
    if isinstance(tree, tuple):
        return f"IF({x}.{tree[0]} <= {tree[1]}, {_sql(tree[2], x)}, {_sql(tree[3], x)})"
    return f"{tree:.6f}D"


def _splits(tree):
    """A tree without its leaves' weights."""
    return (*tree[:2], *map(_splits, tree[2:])) if isinstance(tree, tuple) else None


def _added(trees: list):
    """The sum of trees that split alike."""
    return (*trees[0][:2], *(_added(list(side)) for side in zip(*(t[2:] for t in trees), strict=True))) if isinstance(trees[0], tuple) else sum(trees)


class Boosted:
    """Logistic boosting of small trees for one kind, and its calibrated threshold."""

    def __init__(self, fit: list[tuple[dict, float, float]], held: list[tuple[dict, float, float]]):
        """Both: (feature values, weight of positive, weight of negative examples)."""
        self.trees, scores = [], [0.0] * len(fit)
        values = [tuple(x[f] for f in FEATURES) for x, _, _ in fit]
        for _ in range(TREES):
            rows = []
            for v, (_, yes, no), s in zip(values, fit, scores, strict=True):
                p = 1 / (1 + math.exp(-s))
                rows.append((v, yes * (1 - p) - no * p, (yes + no) * p * (1 - p)))
            tree = _grow(rows, DEPTH)
            self.trees.append(tree)
            scores = [s + RATE * _value(tree, x) for (x, _, _), s in zip(fit, scores, strict=True)]
        self.threshold = self._calibrate(held)

    def _calibrate(self, held) -> float:
        """The least score above 0 from which on the share of positive among the held out is PRECISION."""
        total: dict[float, list[float]] = {}
        for x, y, n in held:
            sums = total.setdefault(round(self.score(x), 6), [0.0, 0.0])
            sums[0] += y
            sums[1] += n
        yes = no = 0.0
        best = math.inf
        for s, (y, n) in sorted(total.items(), reverse=True):
            yes, no = yes + y, no + n
            if s > 0 and yes >= PRECISION * (yes + no):
                best = s
        return best - 1e-4

    def score(self, x: dict) -> float:
        return RATE * sum(_value(t, x) for t in self.trees)

    def sql(self, x: str) -> str:
        """Trees that split alike are one, whose leaves are their sums."""
        alike: dict[tuple | None, list] = {}
        for t in self.trees:
            alike.setdefault(_splits(t), []).append(t)
        return f"({RATE}D * ({' + '.join(_sql(_added(ts), x) for ts in alike.values())}))"

    def features(self) -> set[str]:
        """Features that some tree splits on."""
        out, todo = set(), [*self.trees]
        while todo:
            if isinstance(t := todo.pop(), tuple):
                out.add(t[0])
                todo += t[2:]
        return out


def _numbers(kind: str, rnd: random.Random) -> str:
    """A made-up number or address of the kind that passes its exact test."""
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    if kind == "email":
        user, host, top = rnd.choice(["jo", "mary.poe", "k_lang7", "info"]), rnd.choice(["mail", "acme", "uni-x"]), rnd.choice(["com", "org", "de", "fr"])
        return rnd.choice(["{} at {} dot {}", "{} (at) {}.{}", "{}[at]{}.{}", "{}@{} dot {}", "{} [at] {} [dot] {}", "{}(at){}(dot){}"]).format(user, host, top)
    if kind == "ip":
        a = [str(rnd.randrange(1, 256)) for _ in range(4)]
        return rnd.choice([".".join(a), "[.]".join(a), "{}.{}[.]{}.{}".format(*a), "(.)".join(a)])
    if kind == "card":
        d = rnd.choice(["4", "51", "55", "23", "37", "6011", "9", "10", "7"])
        n = 15 if d == "37" else rnd.choice([16, 16, 16, 16, 13, 19])
        d += digits(n - 1 - len(d))
        s = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        d += str(-s % 10)
        mark = rnd.choice(["", " ", "-", "."])
        return mark.join((d[:4], d[4:8], d[8:12], d[12:])) if len(d) == 16 else mark.join((d[:4], d[4:10], d[10:])) if len(d) == 15 else d
    return rnd.choice(["+1 ({}) 555-{}", "+44 {} 94{}", "({}) 555-{}", "{}-555-{}", "0{} 55 {}", "{}.555.{}", "{}55{}"]).format(digits(3), digits(4))


def seeds(spark: SparkSession) -> DataFrame:
    """(fold, y, text, kind, s, e): SEEDS with made-up numbers, each kind's phrases SEED_ROUNDS times. Cards whose first digits no issuer has are never positive."""
    rnd, rows = random.Random(12), []
    for kind, groups in SEEDS.items():
        for y, phrases in zip((1, 0), groups, strict=True):
            for k in range(SEED_ROUNDS):
                for phrase in phrases:
                    number = _numbers(kind, rnd)
                    while y and kind == "card" and (number[0] not in "23456" or (phrase == "was {} and" and number[0] != "4")):
                        number = _numbers(kind, rnd)
                    if kind == "phone" and phrase == "was {} and":
                        number = "".join(rnd.choice("0123456789") for _ in range(rnd.randrange(7, 12)))
                    if not y and kind == "phone" and number[0] == "+" and "=" not in phrase:
                        number = number.replace("+", "").replace("(", "").replace(")", "")
                    if kind == "email" and not y and k % 2:
                        number = rnd.choice(["home", "two", "it"]) + rnd.choice(["@", " at "]) + rnd.choice(["once", "noon", "will", "best"]) + rnd.choice(["", " dot it"])
                    s = phrase.index("{")
                    rows.append(f"({int(k % 4 == 3)}, {y}, {_q(phrase.replace('{}', number))}, {_q(kind)}, {s}, {s + len(number)})")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(fold, y, text, kind, s, e)")


def examples(docs: DataFrame) -> DataFrame:
    """(seed, fold, y, k, features) of every example of ``docs`` and of the seeds."""
    key = F.xxhash64(F.col("doc_id").cast("string") if "doc_id" in docs.columns else F.lit(""), "text")
    own = _spans(docs.select("text", key.alias("key")).where(F.col("text").rlike(r"@|[0-9]{3}|[0-9][.\[( ]|[(\[]at| dot ")))
    own = own.selectExpr("0 AS seed", "CAST(pmod(key DIV 7, 4) = 0 AS INT) AS fold", "text", "_masked", "_base", "0 AS y")
    phrases = seeds(docs.sparkSession).selectExpr("1 AS seed", "fold", "text", "'' AS _masked", "array(named_struct('k', kind, 's', s, 'e', e)) AS _base", "y")
    # corpus and seeds, texts and what the rules leave of them share one copy of the generators; without the condition, which always
    # holds, Catalyst would copy it into both sides of the union and, as it plans, run that of the seeds on the driver
    found = own.union(phrases).withColumn("_found", F.expr(f"IF(spark_partition_id() >= 0, transform(array(text, _masked), tx -> {_proposed('tx')}), NULL)"))
    both = _let("_found", "f", _examples("f[0]", "f[1]", "_base"))
    # explode_outer: a plain explode adds a filter that would repeat all the expressions below it
    rows = found.select("seed", "fold", "y", F.explode_outer(F.expr(both)).alias("x")).where("x IS NOT NULL")
    return rows.select("seed", "fold", F.expr("IF(seed = 1, y, x.y)").alias("y"), *(F.col(f"x.c.{x}") for x in ("k", *FEATURES)))


def train(docs: DataFrame) -> dict[str, Boosted]:
    """A model for each kind, from the seeds and all of ``docs`` (text, and doc_id where there is one).

    What reaches the driver are counts by feature values: no more rows than
    there are values, for any input. A kind without examples in ``docs`` is
    judged as the seeds teach.
    """
    by = ("seed", "fold", "y", "k", *FEATURES)
    counts = examples(docs).groupBy(*by).agg(F.count("*").alias("n")).orderBy(*by).collect()
    release_driver(docs.sparkSession)  # planning this took much
    assert len(counts) <= 8 * len(KINDS) * math.prod(len(v) for v in FEATURES.values())
    out = {}
    for kind in KINDS:
        sides = []
        for fold in (0, 1):
            own = [r for r in counts if r.k == kind and r.fold == fold]
            total = {}
            for r in own:
                total[r.seed, r.y] = total.get((r.seed, r.y), 0) + r.n
            table: dict[tuple, list[float]] = {}
            for r in own:
                weight = r.n * GROUP_WEIGHT / max(total[r.seed, r.y], LEAST)
                table.setdefault(tuple(r[x] for x in FEATURES), [0.0, 0.0])[1 - r.y] += weight
            sides.append([(dict(zip(FEATURES, v, strict=True)), *w) for v, w in table.items()])
        out[kind] = Boosted(*sides)
    return out


def find(docs: DataFrame, models: dict[str, Boosted] | None = None) -> DataFrame:
    """``docs`` with two columns more: ``_base``, the rules' spans, and ``_all``, those and the trees'; (k, s, e) in order of s, then kind.

    A candidate is added if its kind's trees accept it, its exact test holds,
    it overlaps no rule's span and none of its two neighbours on either side
    overlaps it with a better score (or as good a one, and earlier). Null texts
    count as empty and have no spans. Columns of ``docs`` must not begin with
    an underscore (``redact`` takes any).
    """
    models = train(docs) if models is None else models
    text = _spans(docs.withColumn("_text", F.col("text")).withColumn("text", F.coalesce("text", F.lit("")))).drop(*(f"_{k}" for k in KINDS))
    score = "CASE c.k " + " ".join(f"WHEN {_q(k)} THEN {m.sql('c')} - {m.threshold:.6f}D" for k, m in models.items()) + " END"
    scored = f"transform(filter(_more, c -> c.holds), c -> named_struct('s', c.s, 'e', c.e, 'k', c.k, 'p', {score}))"
    out = text.withColumn("_more", F.expr(_proposed("_masked"))).withColumn("_more", F.expr(f"array_sort(filter({scored}, c -> c.p >= 0))"))
    better = " OR ".join(
        f"(i + {d} BETWEEN 0 AND size(_more) - 1 AND c.s < get(_more, i + {d}).e AND get(_more, i + {d}).s < c.e AND get(_more, i + {d}).p {'>=' if d < 0 else '>'} c.p)" for d in (-2, -1, 1, 2)
    )
    added = f"transform(filter(_more, (c, i) -> NOT ({better})), c -> named_struct('k', c.k, 's', c.s, 'e', c.e))"
    return out.withColumn("_all", F.expr(f"IF(size(_more) = 0, _base, {_ordered(f'concat(_base, {added})')})")).withColumn("text", F.col("_text")).drop("_more", "_text", "_masked")


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.k, ':', x.s, ':', x.e)), ',')"


def detect(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and base_sha256 are of the rules' spans, ``spans`` lists all as
    kind:start:end. Null and empty texts have no spans; very long texts are
    searched whole; repeated rows and null ids are treated like others. Further
    columns are not read. Nothing is shuffled but the counts that train the
    trees.
    """
    found = find(docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text"))
    counts = [F.expr(f"CAST(size(filter(_base, x -> x.k = {_q(k)})) AS LONG)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.expr(_joined("_base")), 256).alias("base_sha256"), F.expr(_joined("_all")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets, and ``n_chars`` (where present) set anew.

    Of overlapping spans the first stands for all that it touches. Null texts
    stay null, empty ones empty; very long texts are searched whole. Repeated
    rows and rows without an id are treated like others. Other columns stay as
    they are.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    found = find(docs.select(row.alias("row"), *(["doc_id"] if "doc_id" in docs.columns else []), "text"))
    out = found.withColumn("text", F.expr(f"IF(text IS NULL, text, {_replaced('text', '_all', '''concat('[', upper(x.k), ']')''', _q(''))})"))
    own = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("text").isNull(), own["n_chars"]).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(v.alias(c) for c, v in own.items()))
