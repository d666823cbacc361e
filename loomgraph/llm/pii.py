"""Personal data by weak supervision.

Base patterns (email, ip, card, phone) are found exactly and always stay. Wider patterns propose
further candidates: e-mail addresses spelt out, national phone numbers, grouped account numbers,
identity numbers, and credentials. On every candidate, base ones included, labelers vote yes, no
or nothing:

* regex labelers: strict form, check digit, plausible length;
* gazetteer labelers: known top-level domains; country codes and North American area-code ranges
  (nothing for national numbers of other forms); address ranges that are no documentation or local ones;
* context labelers: telling words shortly before ("call", "mail", "card", "ssn", ...) and telling
  surroundings of ordinary numbers ("page", "version", "figure", ...).

Candidates of equal votes and shape are counted over all documents (a table bounded by the number
of such patterns, whatever the corpus). Expectation-maximisation on the votes estimates how
reliable each labeler is and how likely each pattern is personal; the counts weighted with these
likelihoods train a logistic span classifier over kind, votes, the span's length and its shares of
digits and capitals, and the characters beside it. It accepts candidates from `accept` on.

Null texts hold nothing. Repeated rows each get a row. Overlapping spans: base spans come first,
then the longer candidate, then the earlier. Candidates never reach over a line end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common

#: The base patterns, in the order in which spans are listed.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The ip pattern in time linear in the text: what follows a run of digits decides for all starts within the run.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
#: Candidate patterns beyond the base ones, by kind. None tries a run of characters from each of its starts.
WIDER = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[{]at[)\]}] ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[{]dot[)\]}]) ?[A-Za-z0-9-]+)+"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.-])\(?0?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    "national_id": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "credential": re.compile(r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|(?i:password|passwd|secret|token|api_key)\s?[=:]\s?\"?[^\s\"]{8,})"),
}
KINDS = (*BASE, *(k for k in WIDER if k not in BASE))
#: Gazetteer of frequent top-level domains, and words that tell what a number is.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz de fr es it nl uk us ca au jp cn in br ru ch at se no dk fi pl pt be ie eu io".split())
#: Ranges of addresses for documentation, of this host and network, and broadcast, by their first octets.
NO_HOST = frozenset([(192, 0, 2), (198, 51, 100), (203, 0, 113), (0,), (127,), (255,)])
#: Country codes of telephone numbers as assigned by the ITU.
COUNTRY_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 "
    "211 212 213 216 218 220 221 222 223 224 225 226 227 228 229 230 231 232 233 234 235 236 237 238 239 240 241 242 243 244 245 246 247 248 249 "
    "250 251 252 253 254 255 256 257 258 260 261 262 263 264 265 266 267 268 269 290 291 297 298 299 350 351 352 353 354 355 356 357 358 359 "
    "370 371 372 373 374 375 376 377 378 379 380 381 382 383 385 386 387 389 420 421 423 500 501 502 503 504 505 506 507 508 509 590 591 592 593 "
    "594 595 596 597 598 599 670 672 673 674 675 676 677 678 679 680 681 682 683 685 686 687 688 689 690 691 692 800 808 850 852 853 855 856 870 "
    "878 880 881 882 883 886 888 960 961 962 963 964 965 966 967 968 970 971 972 973 974 975 976 977 979 992 993 994 995 996 998".split()
)
#: North American area codes: 2-9, then 0-8, no x11, and not the reserved 37x and 96x.
AREA_CODE = re.compile(r"(?!.11|37|96)[2-9][0-8][0-9]")
TELLING = {
    "email": re.compile(r"(?i)mail|contact|write|correo|courriel|adresse"),
    "ip": re.compile(r"(?i)\bip\b|address|host|login|client"),
    "card": re.compile(r"(?i)card|visa|payment|karte|carte|tarjeta"),
    "phone": re.compile(r"(?i)call|phone|\btel|mobile|fax|anruf|appel|llam"),
    "iban": re.compile(r"(?i)iban|account|bank|konto|compte|cuenta"),
    "national_id": re.compile(r"(?i)ssn|social|insurance|identity"),
    "credential": re.compile(r"(?i)key|login|password|secret|token"),
}
ORDINARY = re.compile(r"(?i)\b(?:page|version|chapter|figure|section|isbn|article|no|vol)\W*$")
LABELERS = 7


def digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def luhn(number: str) -> bool:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(number)))
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    x = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def phone_known(span: str, number: str) -> str:
    """+ or - from the code tables, 0 for national numbers that do not begin with an area code of three digits."""
    if span.startswith("+"):
        code = next((number[:k] for k in (1, 2, 3) if number[:k] in COUNTRY_CODES), None)
        return "+" if code and (code != "1" or AREA_CODE.match(number, 1)) else "-"
    if len(number) != 10 or number[0] == "0":
        return "0"
    return "+" if AREA_CODE.match(number) else "-"


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the e-mail pattern, in time linear in the text: each starts where the run before its @ does."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        if domain := _DOMAIN.match(text, at + 1):
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost, non-overlapping matches of each kind; matches that fail their check are dropped, without retries."""
    out = []
    out += [("email", a, b) for a, b in _emails(text)]
    if re.search("[0-9]", text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in BASE["card"].finditer(text):
            number = digits(m.group())
            if 13 <= len(number) <= 19 and luhn(number):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in BASE["phone"].finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return out


def wider_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates of the wider patterns that overlap no base span nor one another."""
    found = []
    for kind, pattern in WIDER.items():
        if kind == "email" and not re.search(r"[(\[{]at[)\]}]", text):
            continue
        found += [(kind, *m.span()) for m in pattern.finditer(text)]
    if not found:
        return []
    covered, out = bytearray(len(text)), []
    for _, a, b in taken:
        covered[a:b] = b"\1" * (b - a)
    for kind, a, b in sorted(found, key=lambda x: (x[1] - x[2], x[1], x[0])):
        if covered.find(1, a, b) < 0:
            covered[a:b] = b"\1" * (b - a)
            out.append((kind, a, b))
    return out


#: Bounds of span lengths that the classifier tells apart.
LENGTHS = (8, 12, 16, 24, 40)
SHAPES = (len(LENGTHS) + 1, 4, 3, 3, 3)


def shape(text: str, a: int, b: int) -> str:
    """A digit for each: length, share of digits, share of capitals, what stands before and after (nothing or white space, a word character, other)."""
    span = text[a:b]
    share = lambda n, of: min(of - 1, int(n * of / len(span)))
    beside = lambda c: 0 if not c or c.isspace() else 1 if c.isalnum() or c == "_" else 2
    return f"{sum(len(span) >= x for x in LENGTHS)}{share(len(digits(span)), SHAPES[1])}{share(sum(map(str.isupper, span)), SHAPES[2])}{beside(text[a - 1 : a])}{beside(text[b : b + 1])}"


def votes(kind: str, text: str, a: int, b: int, base: bool) -> str:
    """One of + - 0 from each labeler."""
    span, before = text[a:b], text[max(0, a - 30) : a]
    number, sign = digits(span), lambda x: "+" if x else "-"
    strict = "+" if base or kind in ("iban", "national_id", "credential") else "0"  # a looser form tells nothing by itself
    check = {"card": lambda: sign(luhn(number)), "iban": lambda: sign(iban_ok(span)), "national_id": lambda: sign(number[:3] not in ("000", "666") and number[0] != "9" and number[3:5] != "00")}.get(kind, lambda: "0")()
    length = {"phone": lambda: sign(9 <= len(number) <= 15), "card": lambda: sign(len(number) in (13, 15, 16, 19)), "credential": lambda: sign(len(span) >= 12)}.get(kind, lambda: "0")()
    gazetteer = "0"
    if kind == "email":
        gazetteer = sign(re.split(r"[.\s)\]}]+", span.lower())[-1] in TOP_LEVEL)
    elif kind == "ip":
        octets = tuple(map(int, span.split(".")))
        gazetteer = sign(octets[:1] not in NO_HOST and octets[:3] not in NO_HOST)
    elif kind == "phone":
        gazetteer = phone_known(span, number)
    told = "+" if TELLING[kind].search(before) else "0"
    ordinary = "-" if ORDINARY.search(before) else "0"
    mixed = sign(len(set(number)) > 3) if number and kind != "ip" else "0"
    return strict + check + length + gazetteer + told + ordinary + mixed


def estimate(patterns: dict[tuple[str, ...], int], rounds: int = 50, prior: float = 0.7) -> tuple[dict, dict]:
    """EM over counted vote patterns: how likely each is personal, and each labeler's (true, false) rates of +, - and 0.

    Labelers are taken as independent given the truth. A plus never speaks against a candidate, a
    minus never for it, and no vote says nothing; so no class can stand for a kind in place of the
    truth. Base spans (a plus of the first labeler, in a kind that has base spans) are personal by
    definition and anchor the estimate.
    """
    keys = sorted(patterns)
    if not keys:
        return {}, {}
    n = np.array([patterns[k] for k in keys], float)
    v = np.array([["+-0".index(c) for c in k[1]] for k in keys])
    kinds = sorted({k[0] for k in keys})
    kind = np.array([kinds.index(k[0]) for k in keys])
    smooth = np.array([[3.0, 1.0, 2.0], [1.0, 3.0, 2.0]])  # [truth][vote]
    likely = np.clip((1 + (v == 0).sum(1)) / (2 + (v != 2).sum(1)), 0.05, 0.95)
    known = np.array([k[0] in BASE and k[1][0] == "+" for k in keys])
    likely[known] = 0.98
    rates = np.zeros((2, LABELERS, 3))
    for _ in range(rounds):
        weight = np.stack([n * likely, n * (1 - likely)])
        for truth in (0, 1):
            for j in range(LABELERS):
                c = np.bincount(v[:, j], weight[truth], 3) + smooth[truth]
                rates[truth, j] = c / c.sum()
        share = (np.bincount(kind, weight[0], len(kinds)) + 10 * prior) / (np.bincount(kind, n, len(kinds)) + 10)
        odds = np.log(rates[0]) - np.log(rates[1])  # [labeler][vote]
        odds = np.stack([np.maximum(odds[:, 0], 0), np.minimum(odds[:, 1], 0), np.zeros(LABELERS)], 1)
        log = odds[np.arange(LABELERS)[None, :], v].sum(1)
        likely = 1 / (1 + np.exp(np.clip(np.log(1 - share[kind]) - np.log(share[kind]) - log, -50, 50)))
        likely[known] = np.maximum(likely[known], 0.98)
    return dict(zip(keys, likely, strict=True)), {j: rates[:, j] for j in range(LABELERS)}


WIDTH = 1 + len(KINDS) + 2 * LABELERS + sum(SHAPES)


def features(kind: str, vote: str, form: str) -> np.ndarray:
    x = np.zeros(WIDTH)
    x[0] = x[1 + KINDS.index(kind)] = 1
    for j, c in enumerate(vote):
        if c != "0":
            x[1 + len(KINDS) + 2 * j + (c == "-")] = 1
    begin = WIDTH - sum(SHAPES)
    for c, n in zip(form, SHAPES, strict=True):
        x[begin + int(c)] = 1
        begin += n
    return x


def train(patterns: dict[tuple[str, str, str], int], likely: dict[tuple[str, str], float], rounds: int = 200, decay: float = 1.0) -> np.ndarray:
    """Weights of the span classifier, by Newton steps on likelihood-weighted counts."""
    keys = sorted(patterns)
    w = np.zeros(WIDTH)
    if not keys:
        return w
    x, n, y = np.array([features(*k) for k in keys]), np.array([patterns[k] for k in keys], float), np.array([likely[k[:2]] for k in keys])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + decay * np.eye(len(w)), x.T @ (n * (y - p)) - decay * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


CANDIDATES = "doc_id long, base array<struct<kind:string,a:long,b:long>>, wide array<struct<kind:string,a:long,b:long,votes:string>>, base_votes array<string>"
SPAN = pa.struct([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64())])
WIDE = pa.struct([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("votes", pa.string())])
CANDIDATE_TYPES = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(SPAN)), ("wide", pa.list_(WIDE)), ("base_votes", pa.list_(pa.string()))])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.chunks(batches, 1):
        base, wide, voted = [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            b = base_spans(text)
            w = wider_spans(text, b)
            base.append([{"kind": k, "a": x, "b": y} for k, x, y in b])
            wide.append([{"kind": k, "a": x, "b": y, "votes": f"{votes(k, text, x, y, False)} {shape(text, x, y)}"} for k, x, y in w])
            voted.append([f"{k} {votes(k, text, x, y, True)} {shape(text, x, y)}" for k, x, y in b])
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip((base, wide, voted), CANDIDATE_TYPES.types[1:], strict=True))], schema=CANDIDATE_TYPES)


def learn(found: DataFrame, accept: float = 0.5) -> list[str]:
    """The patterns, "kind votes shape", that the classifier accepts, from candidates of a whole corpus."""
    wide = found.select(F.explode("wide").alias("c")).select(F.concat_ws(" ", "c.kind", "c.votes").alias("p"))
    counted = found.select(F.explode("base_votes").alias("p")).unionByName(wide).groupBy("p").count()
    patterns = {tuple(r["p"].split(" ")): r["count"] for r in counted.collect()}  # bounded by kinds, votes and shapes
    by_votes: dict[tuple[str, str], int] = {}
    for k, n in patterns.items():
        by_votes[k[:2]] = by_votes.get(k[:2], 0) + n
    likely, _ = estimate(by_votes)
    weights = train(patterns, likely)
    return [" ".join(k) for k in sorted(patterns) if features(*k) @ weights >= np.log(accept / (1 - accept))]


def find(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """Per document row: doc_id, base and added spans, arrays of (kind, a, b), code points, end exclusive.

    The texts are read once; the candidates, a small table, are written to the shared folder
    and serve both the estimation and the result.
    """
    found = common.spill(common.pick(docs, doc_id="long", text="string").mapInArrow(_candidates, CANDIDATES), "pii")
    chosen = learn(found, accept)
    good = F.array(*map(F.lit, chosen)) if chosen else F.array().cast("array<string>")
    added = F.filter("wide", lambda c: F.array_contains(good, F.concat_ws(" ", c["kind"], c["votes"])))
    return found.select("doc_id", "base", F.transform(added, lambda c: F.struct(c["kind"].alias("kind"), c["a"].alias("a"), c["b"].alias("b"))).alias("added"))


def joined(spans) -> F.Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    order = F.array(*map(F.lit, KINDS))
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("o"), s["a"].alias("a"), s["b"].alias("b"), s["kind"].alias("k"))))
    return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["k"], s["a"], s["b"])), ",")


def digest(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """Per document row: doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all), n_spans (of all)."""
    found = find(docs, accept)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))


def redact(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """The documents, all columns, with every span of their texts replaced by its kind in angle brackets."""
    at, schema = common.position(docs, "text"), docs.schema
    chosen = set(learn(common.pick(docs, doc_id="long", text="string").mapInArrow(_candidates, CANDIDATES), accept))

    def task(batches):
        for batch in common.chunks(batches, at):
            out = []
            for text in batch.column(at).to_pylist():
                spans = base_spans(text or "")
                spans += [s for s in wider_spans(text or "", spans) if f"{s[0]} {votes(s[0], text, s[1], s[2], False)} {shape(text, s[1], s[2])}" in chosen]
                last = len(text or "") + 1
                for kind, a, b in sorted(spans, key=lambda s: (-s[1], s[2])):
                    if b <= last:  # of base spans of two kinds that overlap, the later start is replaced
                        text, last = f"{text[:a]}<{kind}>{text[b:]}", a
                out.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(task, schema)
