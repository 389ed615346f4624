"""Personal data: patterns, and a linear-chain CRF over word shapes.

Patterns give the base spans (email, ip, card, phone). A conditional random
field adds spans that the patterns miss. It labels the tokens of a text with a
kind or none, from the shapes of a token and its neighbours and from checks of
its digits; Viterbi finds the best labels, in numpy over batches of sequences.

The model is trained here on a small labelled table (``pii_table``): ``TABLE_ROWS``
written texts whose spans are known, among them spans that the patterns miss and
look-alikes that are no personal data. A kind of its own, secret, comes after the base
kinds. A span that the field adds must pass an exact check of its kind (digits, Luhn,
address syntax) and must not meet a base span.

By the model's definition only a token with a digit or '@' can have a kind; all
others are labelled none. A run of such tokens is then independent of the
next, so decoding runs, with the shapes of the tokens around them as features,
gives the best labels of the whole text. Scale: one pass over each document,
no shuffle; the model is a few thousand numbers.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterspark.llm.common import read, rows_of
from meterspark.llm.pii_table import KINDS, TABLE_ROWS, labelled_table

BASE_KINDS = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
GAP = " \t\n\x0b\x0c\r=\"'<>|"      # between tokens
TOKEN = re.compile(r"[^\x20\x09-\x0D=\"'<>|]+")
MAIL = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+")
MARK = re.compile("[0-9@]")
EDGE = ".,;:!?\"'()[]{}<>*#$%&|"

STEPS = 120
AHEAD = 2                   # tokens before a run that its features see
LABELS = 2 * len(KINDS) + 1     # 0: none; 1 + 2 k begins a span of kind k, 2 + 2 k goes on with it
MIN_SEEN = 2                # runs that hold a feature of the model
COUNTS = ("n_email", "n_ip", "n_card", "n_phone")


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octets(text: str) -> bool:
    """Parts of an address are at most 255; leading zeros do not count, however many."""
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _emails(text: str):
    """What ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` matches, from
    one '@' to the next, in linear time for words of any length."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind. Per kind the leftmost matches
    that do not overlap; one that fails its check is dropped and not tried again."""
    if not MARK.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _octets(m.group())]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15] if "+" in text else []
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def shape(token: str) -> str:
    """Letters as x or X, digits as 9 (groups of them with their length), others as they are."""
    out = re.sub("[0-9]+", lambda m: f"9{min(len(m.group()), 20)}", re.sub("[^\\W\\d_]+", lambda m: "X" if m.group().isupper() else "x", token))
    return out if len(out) <= 40 else out[:20] + "~" + out[-20:]


def _address(text: str) -> bool:
    try:
        return bool(ipaddress.ip_address(text))
    except ValueError:
        return False


def token_features(tokens: list[str], i: int) -> list[str]:
    core = tokens[i].strip(EDGE)
    d = digits_of(core)
    near = [tokens[j].strip(EDGE) if 0 <= j < len(tokens) else "^" for j in (i - 2, i - 1, i + 1)]
    own, before, after = shape(core), shape(near[1]), shape(near[2])
    mix = "".join(c for c, p in zip("aA9.", ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")) if re.search(p, core))
    switches = len(re.findall("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])", core))
    out = ["shape " + own, "kinds " + re.sub(r"\d+", "", own), f"digits {min(len(d), 20)}", f"at {core.count('@')}", f"mail {MAIL.fullmatch(core) is not None}", f"dots {min(core.count('.'), 4)}",
           f"luhn {luhn(d)}" if 14 <= len(d) <= 19 else "luhn -", f"address {_address(core)}" if 2 < len(core) < 46 and core.count(".") + core.count(":") > 1 else "address -",
           "plus" if tokens[i][:1] == "+" else "no plus", "bracket" if tokens[i][:1] == "(" else "no bracket", "before " + before, "after " + after, "both " + before + " " + own,
           "mix " + mix, f"size {min(len(core), 64) // 4} {mix}", f"switches {min(switches, 12) // 2}"]
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", core) and len(d) < len(core):
        out.append(f"hex {min(len(core), 64) // 8}")
    for place, word in zip(("second", "first"), near):
        word = word.rstrip("-_.").lower()
        if len(word) <= 16 and re.fullmatch("[a-z_-]+", word):
            out += [f"{place} {word}", f"{place} {word} {mix} {len(core) > 15}"]
    return out


def _before(text: str, start: int) -> list[str]:
    """Up to ``AHEAD`` tokens that end before ``start``."""
    out = []
    while len(out) < AHEAD:
        while start and text[start - 1] in GAP:
            start -= 1
        if not start:
            break
        end = start
        while start and text[start - 1] not in GAP:
            start -= 1
        out.append(text[start:end])
    return out[::-1]


def runs(text: str) -> list[tuple[list[str], list[tuple[int, int]], int]]:
    """Runs of neighbouring tokens that have a digit or '@': the tokens with
    some before and one after, the spans of the run's own tokens without outer
    punctuation, and the number of tokens before."""
    out, current = [], []
    if not MARK.search(text):
        return out
    marked = [m.span() for m in TOKEN.finditer(text) if MARK.search(m.group())]
    for span in marked:
        if current and text[current[-1][1]:span[0]].strip(GAP):
            out.append(current)
            current = []
        current.append(span)
    out += [current] if current else []
    found = []
    for spans in out:
        left, right = _before(text, spans[0][0]), TOKEN.search(text, spans[-1][1])
        cores = []
        for a, b in spans:
            token = text[a:b]
            head = len(token) - len(token.lstrip(EDGE))
            cores.append((a + head, max(a + head, a + len(token.rstrip(EDGE)))))
        found.append((left + [text[a:b] for a, b in spans] + ([right.group()] if right else []), cores, len(left)))
    return found


def run_features(tokens: list[str], n: int, lead: int) -> list[list[str]]:
    return [token_features(tokens, lead + i) for i in range(n)]


class Model:
    """Feature ids, weights by feature and label, and label transitions (from
    the row to the column; none stands before and after a run)."""

    def __init__(self, ids: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.ids, self.weights, self.moves = ids, weights, moves

    def scores(self, rows: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Padded label scores (run, place, label) and lengths."""
        lengths = np.array([len(r) for r in rows])
        out = np.zeros((len(rows), lengths.max(initial=1), LABELS))
        for i, row in enumerate(rows):
            for j, names in enumerate(row):
                known = [k for k in map(self.ids.get, names) if k is not None]
                out[i, j] = self.weights[known].sum(axis=0)
        return out, lengths

    def viterbi(self, rows: list[list[list[str]]]) -> list[list[int]]:
        if not rows:
            return []
        emit, lengths = self.scores(rows)
        n, steps, _ = emit.shape
        best = emit[:, 0] + self.moves[0]
        came = np.zeros((n, steps, LABELS), np.int8)
        for j in range(1, steps):
            through = best[:, :, None] + self.moves[None]
            came[:, j] = through.argmax(axis=1)
            now = through.max(axis=1) + emit[:, j]
            best = np.where((j < lengths)[:, None], now, best)
        state = (best + self.moves[:, 0]).argmax(axis=1)
        out = np.zeros((n, steps), np.int8)
        for j in range(steps - 1, -1, -1):
            inside = j < lengths
            out[:, j] = np.where(inside, state, 0)
            if j:
                state = np.where(inside, came[np.arange(n), j, state], state)
        return [out[i, :k].tolist() for i, k in enumerate(lengths)]


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=1, keepdims=True)


def fit(table: list[tuple[list[list[str]], list[int]]], steps: int = STEPS, ridge: float = 0.02) -> Model:
    """Maximum likelihood with a ridge, by forward-backward sums over all runs
    and Adam steps."""
    seen: dict[str, int] = {}
    for row, _ in table:
        for name in {f for names in row for f in names}:
            seen[name] = seen.get(name, 0) + 1
    ids = {name: i for i, name in enumerate(sorted(n for n, k in seen.items() if k >= MIN_SEEN))}
    model = Model(ids, np.zeros((len(ids), LABELS)), np.zeros((LABELS, LABELS)))
    if not table or not ids:
        return model
    lengths = np.array([len(r) for r, _ in table])
    n, steps_in = len(table), lengths.max()
    gold = np.zeros((n, steps_in), int)
    at, places = [], []
    for i, (row, labels) in enumerate(table):
        gold[i, :len(labels)] = labels
        for j, names in enumerate(row):
            known = [ids[f] for f in names if f in ids]
            at += known
            places += [i * steps_in + j] * len(known)
    at, places = np.array(at), np.array(places)
    used, starts = np.unique(places, return_index=True)        # places ascend
    by_feature = np.argsort(at, kind="stable")
    features, feature_starts = np.unique(at[by_feature], return_index=True)
    inside = np.arange(steps_in)[None] < lengths[:, None]
    truth = np.zeros((n, steps_in, LABELS))
    truth[np.arange(n)[:, None], np.arange(steps_in)[None], gold] = 1
    truth *= inside[..., None]
    pairs = np.zeros((LABELS, LABELS))
    np.add.at(pairs, (np.zeros(n, int), gold[:, 0]), 1)
    np.add.at(pairs, (gold[np.arange(n), lengths - 1], np.zeros(n, int)), 1)
    for j in range(1, steps_in):
        on = inside[:, j]
        np.add.at(pairs, (gold[on, j - 1], gold[on, j]), 1)
    slopes = [(np.zeros_like(p), np.zeros_like(p)) for p in (model.weights, model.moves)]
    for step in range(1, steps + 1):
        emit = np.zeros((n * steps_in, LABELS))
        emit[used] = np.add.reduceat(model.weights[at], starts)
        emit = emit.reshape(n, steps_in, LABELS)
        here, through = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(model.moves)
        ahead, back = np.zeros_like(emit), np.zeros_like(emit)          # each row scaled to a sum of one
        ahead[:, 0] = _scaled(here[:, 0] * through[0])
        for j in range(1, steps_in):
            ahead[:, j] = np.where(inside[:, j, None], _scaled(ahead[:, j - 1] @ through * here[:, j]), ahead[:, j - 1])
        back[:, -1] = through[:, 0]
        for j in range(steps_in - 2, -1, -1):
            back[:, j] = np.where(inside[:, j + 1, None], _scaled(here[:, j + 1] * back[:, j + 1] @ through.T), through[:, 0])
        some = ahead * back
        some *= inside[..., None] / some.sum(axis=2, keepdims=True)
        both = np.zeros((LABELS, LABELS))
        both[0] += some[:, 0].sum(axis=0)
        both[:, 0] += some[np.arange(n), lengths - 1].sum(axis=0)
        for j in range(1, steps_in):
            on = inside[:, j]
            before, after = ahead[on, j - 1], here[on, j] * back[on, j]
            both += through * (before.T @ (after / (before @ through * after).sum(axis=1, keepdims=True)))
        slope = np.zeros_like(model.weights)
        slope[features] = np.add.reduceat((truth - some).reshape(-1, LABELS)[places[by_feature]], feature_starts)
        for p, g, (m, v) in zip((model.weights, model.moves), (slope - ridge * model.weights, pairs - both - ridge * model.moves), slopes):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def labelled(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[list[list[str]], list[int]]]:
    """The runs of a text, each token labelled by the span over it."""
    out = []
    for tokens, cores, lead in runs(text):
        over = [next((s for s in spans if s[0] < b and a < s[2]), None) for a, b in cores]
        labels = [0 if s is None else 1 + 2 * s[1] + (i > 0 and over[i - 1] == s) for i, s in enumerate(over)]
        out.append((run_features(tokens, len(cores), lead), labels))
    return out


def holds(kind: int, text: str) -> bool:
    """The exact check of an added span."""
    d, name = digits_of(text), KINDS[kind]
    if name == "email":
        return MAIL.fullmatch(text) is not None
    if name == "ip":
        return _address(text)
    if name == "secret":
        return len(text) >= 8 and not any(c in GAP for c in text.rstrip("="))
    return not re.search(r"[^\W\d_]", text) and (14 <= len(d) <= 19 and luhn(d) if name == "card" else 7 <= len(d) <= 15)


def added_spans(text: str, found: list, labels: list[list[int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the labelled tokens that pass their check, without those that meet a base span."""
    out = []
    for (_, cores, _), row in zip(found, labels):
        i = 0
        while i < len(row):
            j = i
            if row[i]:
                kind = (row[i] - 1) // 2
                while j + 1 < len(row) and row[j + 1] == 2 + 2 * kind:
                    j += 1
                a, b = cores[i][0], cores[j][1]
                if text[a - 1:a] in ("+", "("):                 # outer punctuation that belongs to a number
                    a -= KINDS[kind] == "phone"
                if KINDS[kind] == "secret":                     # base64 padding
                    b += 2 if text[b:b + 2] == "==" else text[b:b + 1] == "="
                if a < b and holds(kind, text[a:b]) and not any(s < b and a < e for s, _, e in base):
                    out.append((a, kind, b))
            i = j + 1
    return out


def _find_batches(model, batches):
    crf = model.value
    for batch in batches:
        for part in rows_of(batch):
            out = {k: [] for k in COUNTS + ("base_sha256", "spans", "n_added")}
            texts = [t or "" for t in part.column(1).to_pylist()]
            found = [runs(t) for t in texts]
            asked = [run_features(tokens, len(cores), lead) for f in found for tokens, cores, lead in f]
            labels = iter([x for at in range(0, len(asked), 512) for x in crf.viterbi(asked[at:at + 512])])
            for text, f in zip(texts, found):
                base = base_spans(text)
                added = added_spans(text, f, [next(labels) for _ in f], base)
                for k, kind in enumerate(BASE_KINDS):
                    out["n_" + kind].append(sum(s[1] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                out["spans"].append(written(sorted(base + added)))
                out["n_added"].append(len(added))
            yield pa.RecordBatch.from_arrays([part.column(0)] + [pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in out.items()], ["doc_id", *out])


def train(table: list[tuple[str, list[tuple[int, int, int]]]] | None = None) -> Model:
    """The model from a labelled table of texts with their spans (start, kind, end);
    without one, from the ``TABLE_ROWS`` written rows of ``pii_table``."""
    table = labelled_table(TABLE_ROWS) if table is None else table
    return fit([x for text, spans in table for x in labelled(text, spans)])


def find_pii(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans
    (all spans), n_added (spans that the field adds) for each input row.

    A null or empty text has no spans. Repeated rows and null doc_ids come out
    as they came in; an empty table gives no rows. Other columns are ignored."""
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(partial(_find_batches, docs.sparkSession.sparkContext.broadcast(model)),
                           "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return find_pii(docs, train())
