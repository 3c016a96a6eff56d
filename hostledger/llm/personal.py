"""Personal data by a skip-chain conditional random field over the mentions of each document.

Exact patterns give spans that always stand. Numbers and addresses they did not take become further
mentions whose label is open. Neighbouring mentions are linked in a chain, repeated and similar ones
by skip edges however far apart; labels of open mentions are the marginals of loopy message
passing. Potentials are moments of the whole corpus: label shares by shape of a mention, how often mentions
joined by a kind of skip edge agree, and how much more often two labels are neighbours than by chance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .batches import portions, send_small_batches

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = 1, 2, 3, 4  # labels; 0 is none of them
LABELS = len(KINDS) + 1
EDGES = ("same", "near", "tail", "next to", "close", "far")
AGREEMENT = (0.999, 0.997, 0.99)  # expected share of equal labels along skip edges before any is counted
PRIOR = 20.0  # pairs that this expectation weighs
BACK_OFF = 5.0  # mentions that the share of a coarser shape weighs
MISS = 0.01  # share of true mentions that the patterns are expected to decline although nothing stood in their way
LEAST = 0.6  # marginal from which an open mention is a span
DAMPING, ROUNDS, SETTLED = 0.5, 200, 1e-6

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
DIGIT_GROUPS = re.compile(r"[0-9](?:[ -]?[0-9])+")
WITH_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY_DIGIT = re.compile("[0-9]")
WORD = re.compile(r"[^ ]+")
NUMBER = re.compile(r"\+?\(?[0-9](?:[ ().,/_:\[\]-]{0,3}[0-9])*")
WRITTEN_AT = re.compile(r" ?[\[({<] ?(?:at|AT|At) ?[\])}>] ?| (?:at|AT) |@")
AT_FORMS = ("@", " at ", " AT ", "at)", "AT)", "At)", "at]", "AT]", "At]", "at>", "AT>", "At>", "at}", "AT}", "At}", "at )", "at ]")
DOT = r"(?:\.| ?[\[({<] ?(?:dot|DOT|Dot|\.) ?[\])}>] ?| (?:dot|DOT) )"
WRITTEN_DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+")
ONE_LABEL = re.compile("[A-Za-z0-9-]+")
DOT_WORDS = re.compile(r"(?<![A-Za-z0-9])(?:dot|at)(?![A-Za-z0-9])")
OTHER = re.compile(r"[^a-z0-9]+")
LONG_RUN = 19  # digits up to which a run of numbers is one mention
SHORTEST = 7  # digits of a mention
TAIL = 7
NEAR = range(10, 65)  # lengths of keys that may differ in one place

Span = tuple[int, int, int]  # start, end, label


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def run_start(text: str, least: int, at: int) -> int:
    """Where the run of address characters that ends before ``at`` starts, ``least`` at the earliest."""
    while at > least:
        part = text[max(least, at - 64) : at]
        kept = len(part.rstrip(LOCAL))
        at -= len(part) - kept
        if kept:
            break
    return at


def addresses(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = run_start(text, done, at)
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end(), EMAIL
            done = domain.end()
        at = text.find("@", max(done, at + 1))


def is_octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def is_card(text: str) -> bool:
    digits = digits_of(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def is_phone(text: str) -> bool:
    return 9 <= len(digits_of(text)) <= 15


def base_spans(text: str) -> list[Span]:
    """What the exact patterns find, by start and then by kind."""
    found = list(addresses(text))
    if "." in text:
        found += [(*m.span(), IP) for m in QUAD.finditer(text) if all(map(is_octet, m.groups()))]
    found += [(*m.span(), CARD) for m in DIGIT_GROUPS.finditer(text) if m.end() - m.start() >= 12 and is_card(m[0])]
    if "+" in text:
        found += [(*m.span(), PHONE) for m in WITH_PLUS.finditer(text) if is_phone(m[0])]
    return sorted(found, key=lambda s: (s[0], s[2]))


def passes_alone(text: str) -> bool:
    """Whether the patterns would take ``text`` if nothing stood around it."""
    quad = QUAD.fullmatch(text)
    return bool(
        (quad and all(map(is_octet, quad.groups())))
        or (DIGIT_GROUPS.fullmatch(text) and is_card(text))
        or (WITH_PLUS.fullmatch(text) and is_phone(text))
    )


def number_parts(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """A run of numbers as mentions: whole if it is short, else its long words, and short ones between them together."""
    if len(digits_of(text[start:end])) <= LONG_RUN:
        yield start, end
        return
    first, last, held = None, 0, 0
    for word in WORD.finditer(text, start, end):
        n = len(digits_of(word[0]))
        alone = n >= SHORTEST and not 0 < held + n <= 16
        if first is not None and (alone or held + n > 16):
            yield first, last
            first, held = None, 0
        if alone:
            yield word.span()
        elif n:
            first, last, held = word.start() if first is None else first, word.end(), held + n
    if first is not None:
        yield first, last


def gaps(length: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a text that the spans ``taken``, by start, leave free."""
    free, at = [], 0
    for start, end in [*taken, (length, length)]:
        if start > at:
            free.append((at, start))
        at = max(at, end)
    return free


def written_addresses(text: str, free: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for low, high in free:
        done = low
        for sign in WRITTEN_AT.finditer(text, low, high):
            start = run_start(text, done, sign.start())
            if start == sign.start():
                continue
            domain = WRITTEN_DOMAIN.match(text, sign.end(), high)
            if not domain and sign[0] == "@":
                domain = ONE_LABEL.match(text, sign.end(), high)
            if domain:
                yield start, domain.end()
                done = domain.end()


def open_mentions(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Written-out addresses and numbers of seven digits or more outside the spans ``taken``; none overlap."""
    spans = [(s, e) for s, e, _ in taken]
    found = list(written_addresses(text, gaps(len(text), spans))) if any(form in text for form in AT_FORMS) else []
    if ANY_DIGIT.search(text):
        for low, high in gaps(len(text), sorted([*spans, *found])):
            for run in NUMBER.finditer(text, low, high):
                if run.end() - run.start() >= SHORTEST:
                    found += [p for p in number_parts(text, *run.span()) if len(digits_of(text[slice(*p)])) >= SHORTEST]
    return found


def key_and_shape(text: str) -> tuple[str, str]:
    """What repeated mentions share however they are written, and the form of a mention without its values."""
    if re.search("[A-Za-z@]", text):
        low = text.lower()
        sign = "@" if "@" in text else "at"
        return OTHER.sub("", DOT_WORDS.sub("", low)), f"mail {sign}"
    digits = digits_of(text)
    marks = "".join(sorted({c for c in text if not "0" <= c <= "9"} - {"+", ")", "]"}))
    sound = " card" if DIGIT_GROUPS.fullmatch(text) and is_card(text) else ""
    sound += " phone" if WITH_PLUS.fullmatch(text) and is_phone(text) else ""
    return digits, f"number {marks}|{min(len(digits), 20)}{sound}"


def one_edit(a: str, b: str) -> bool:
    """Whether ``a`` and ``b`` differ by one character changed, added or left out."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def skip_edges(keys: list[str]) -> dict[tuple[int, int], int]:
    """Edges between mentions of equal keys, of keys one edit apart, and of numbers with the same last digits.

    A mention is linked to the first and to the last one before it of the same form, so edges stay in proportion to mentions.
    """
    edges: dict[tuple[int, int], int] = {}
    first: dict[tuple, int] = {}
    last: dict[tuple, int] = {}
    for i, key in enumerate(keys):
        forms: list[tuple] = [(0, key)]
        if len(key) in NEAR:
            forms += [(1, key)] + [(1, key[:k] + key[k + 1 :]) for k in range(len(key))]
        if key.isdigit() and len(key) > TAIL:
            forms.append((2, key[-TAIL:]))
        for form in forms:
            for j in (last.get(form, i), first.setdefault(form, i)):
                if j != i and (j, i) not in edges and (form[0] == 0 or (keys[j] != key and (form[0] == 2 or one_edit(keys[j], key)))):
                    edges[j, i] = form[0]
            last[form] = i
    return edges


def described(text: str) -> tuple[list[tuple], list[tuple]]:
    """Mentions (start, end, label, shape, whether the patterns would take it alone) and edges (i, j, kind of edge)."""
    taken = base_spans(text)
    mentions = [(s, e, label) for s, e, label in taken] + [(s, e, 0) for s, e in open_mentions(text, taken)]
    mentions.sort()
    known = [key_and_shape(text[s:e]) for s, e, _ in mentions]
    edges = skip_edges([k for k, _ in known])
    for i in range(len(mentions) - 1):
        gap = mentions[i + 1][0] - mentions[i][1]
        edges.setdefault((i, i + 1), 3 if gap <= 3 else 4 if gap <= 40 else 5)
    rows = [(s, e, label, shape, label == 0 and passes_alone(text[s:e])) for (s, e, label), (_, shape) in zip(mentions, known, strict=True)]
    return rows, [(i, j, kind) for (i, j), kind in edges.items()]


MENTION = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.int32()), ("shape", pa.string()), ("alone", pa.bool_())])
EDGE = pa.struct([("i", pa.int32()), ("j", pa.int32()), ("kind", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("counts", pa.bool_())])
GRAPH = (
    "doc_id {}, mentions array<struct<start:bigint,end:bigint,label:int,shape:string,alone:boolean>>, "
    "edges array<struct<i:int,j:int,kind:int,a:int,b:int,counts:boolean>>"
)


def graphs(documents: DataFrame) -> DataFrame:
    """doc_id, mentions and edges of every row."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            mentions, edges = [], []
            for text in batch.column("text").to_pylist():
                found, links = described(text or "")
                mentions.append([dict(zip(MENTION.names, m, strict=True)) for m in found])
                edges.append([
                    {"i": i, "j": j, "kind": kind, "a": found[i][2], "b": found[j][2], "counts": is_evidence(found[i], found[j], kind)}
                    for i, j, kind in links
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(mentions, pa.list_(MENTION)), pa.array(edges, pa.list_(EDGE))], ["doc_id", "mentions", "edges"]
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(describe, GRAPH.format(kind))


def is_evidence(a: tuple, b: tuple, kind: int) -> bool:
    """Whether a pair of mentions says how labels meet: not if the patterns would take an open one alone, nor if an
    open one repeats one that has a label, which is what there is to decide."""
    return not (a[4] or b[4]) and (kind >= len(AGREEMENT) or (a[2] == 0) == (b[2] == 0))


class Field:
    """Potentials of the random field from counts (shape, label) and (kind of edge, label, label) of the corpus."""

    def __init__(self, shapes: dict[tuple[str, int], int], pairs: dict[tuple[int, int, int], int]):
        self.shares: dict[str, np.ndarray] = {}
        coarse: dict[str, np.ndarray] = {}
        total = np.ones(LABELS)
        for (shape, label), n in shapes.items():
            for table, at in ((self.shares, shape), (coarse, shape.split("|")[0])):
                table.setdefault(at, np.zeros(LABELS))[label] += n
            total[label] += n
        self.prior = total / total.sum()
        self.coarse = {k: (v + BACK_OFF * self.prior) / (v.sum() + BACK_OFF) for k, v in coarse.items()}
        self.edges = np.zeros((len(EDGES), LABELS, LABELS))
        by_chance = np.outer(self.prior, self.prior)
        for kind in range(len(EDGES)):
            seen = np.zeros((LABELS, LABELS))
            for (k, a, b), n in pairs.items():
                if k == kind:
                    seen[a, b] += n
            if kind < len(AGREEMENT):
                agree = (np.trace(seen) + PRIOR * AGREEMENT[kind]) / (seen.sum() + PRIOR)
                self.edges[kind] = np.log(np.where(np.eye(LABELS, dtype=bool), agree, (1 - agree) / (LABELS - 1)))
            else:
                self.edges[kind] = np.log((seen + PRIOR * by_chance) / (seen.sum() + PRIOR) / by_chance)

    def node(self, shape: str, label: int, alone: bool) -> np.ndarray:
        """Log potentials of a mention: its own label if it has one, else the shares of its shape."""
        if label:
            return np.where(np.arange(LABELS) == label, 0.0, -60.0)
        back = self.coarse.get(shape.split("|")[0], self.prior)
        seen = self.shares.get(shape, np.zeros(LABELS))
        share = (seen + BACK_OFF * back) / (seen.sum() + BACK_OFF)
        declined = np.full(LABELS, 1.0 if alone else MISS)
        declined[0] = 1.0
        return np.log(share * declined)


def marginals(nodes: np.ndarray, edges: np.ndarray, potentials: np.ndarray) -> np.ndarray:
    """Label probabilities of ``nodes`` (log potentials) by damped sum-product messages along ``edges`` (i, j, kind)."""
    belief = nodes.copy()
    if len(edges):
        i, j = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        psi = np.concatenate([potentials[edges[:, 2]], potentials[edges[:, 2]].transpose(0, 2, 1)])
        back = np.roll(np.arange(len(i)), len(edges))  # the message the other way
        message = np.zeros((len(i), nodes.shape[1]))
        for _ in range(ROUNDS):
            from_ = (belief[i] - message[back])[:, :, None] + psi
            most = from_.max(axis=1, keepdims=True)
            sent = np.log(np.exp(from_ - most).sum(axis=1)) + most[:, 0]
            sent -= sent.max(axis=1, keepdims=True)
            change = np.abs(sent - message).max()
            message = DAMPING * message + (1 - DAMPING) * sent
            belief = nodes.copy()
            np.add.at(belief, j, message)
            if change < SETTLED:
                break
    belief = np.exp(belief - belief.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True)


def fit(found: DataFrame) -> Field:
    """The field of the corpus whose ``graphs`` are ``found``; its tables are bounded by the forms that shapes can take.

    Open mentions count as no personal data, but for those that the patterns would take alone, which do not count.
    """
    mentions = found.select(F.inline("mentions")).where(~F.col("alone")).groupBy("shape", "label").count().collect()
    edges = found.select(F.inline("edges")).where("counts").groupBy("kind", "a", "b").count().collect()
    return Field({(r["shape"], r["label"]): r["count"] for r in mentions}, {(r["kind"], r["a"], r["b"]): r["count"] for r in edges})


SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,score:double>>"
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])


def spans_of(mentions: list[dict], edges: list[dict], model: Field, least: float) -> list[dict]:
    """Base spans and the open mentions whose likeliest kind has a marginal of ``least`` or more."""
    scores = None
    if any(not m["label"] for m in mentions):
        nodes = np.array([model.node(m["shape"], m["label"], m["alone"]) for m in mentions])
        scores = marginals(nodes, np.array([(e["i"], e["j"], e["kind"]) for e in edges], np.int64).reshape(-1, 3), model.edges)
    out = []
    for at, m in enumerate(mentions):
        label, score = m["label"], 1.0
        if not label:
            label = 1 + int(scores[at, 1:].argmax())
            score = float(scores[at, label])
            if score < least:
                continue
        out.append({"kind": KINDS[label - 1], "start": m["start"], "end": m["end"], "base": bool(m["label"]), "score": score})
    return sorted(out, key=lambda s: (s["start"], KINDS.index(s["kind"])))


def find_personal_data(documents: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id and spans (kind, start, end, base, score) of every row of ``documents``, in code points, by start and kind.

    Base spans are what the exact patterns of email, ip, card and phone take; they always stand, with
    score 1, and may overlap if their kinds differ. The other spans are open mentions, which overlap no base span and whose marginal in
    the random field is ``least`` or more. The field is fitted on all rows. A null or empty text has no spans;
    repeated rows and rows with a null doc_id are rows like others; texts are read whole at any length. An empty table
    gives no rows, other columns are ignored.
    """
    send_small_batches(documents.sparkSession)
    found = cut_lineage(graphs(documents))
    model = fit(found)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            pairs = zip(batch.column("mentions").to_pylist(), batch.column("edges").to_pylist(), strict=True)
            spans = [spans_of(m, e, model, least) for m, e in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(SPAN))], ["doc_id", "spans"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(decide, f"doc_id {kind}, spans {SPANS}")


def shown(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the first one counts."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def put(held: Column, s: Column) -> Column:
        kept = F.substring(text, (held["at"] + 1).cast("int"), (s["start"] - held["at"]).cast("int"))
        return F.when(s["start"] < held["at"], held).otherwise(
            F.struct(F.concat(held["out"], kept, F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))
        )

    rest = lambda held: F.concat(held["out"], F.substring(text, (held["at"] + 1).cast("int"), F.length(text)))
    return F.aggregate(spans, start, put, rest)
