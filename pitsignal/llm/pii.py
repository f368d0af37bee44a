"""Personal data: base patterns, and a linear-chain conditional random field beside them.

The base finds e-mail addresses, IP numbers, card numbers (Luhn) and phone numbers by their
patterns, leftmost and without overlap within a kind.  The field reads word shapes: a
sequence is the words within ``REACH`` of a word that holds a digit, "@" or "+" (no kind is
written without one), and each word brings its shape, its coarse class and those of its neighbours.
It is trained on a small labelled table: windows of at most ``max_docs`` documents tagged by the base,
and a few hand-tagged lines with forms the base does not know, such as phone numbers
without a plus.  Viterbi decodes padded batches in numpy.  A decoded run of words becomes a
span unless it overlaps a base span; base spans always stay.

Offsets are code points, end exclusive.  A null text is empty and has no span; repeated rows
get the same spans; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.shipping import ship_by_value

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
REACH, MAX_DOCS, MAX_WINDOWS = 3, 4_000, 1_000
CELLS = 1 << 16  # words of one padded Viterbi batch
WORDS = 40  # of a training sequence; a longer window becomes several

# Hand-tagged lines: [kind|words].
TAUGHT = (
    "please call [phone|(555) 201-3344] before noon", "her number is [phone|555-301-8876] or [phone|555 660 1234] at work",
    "tel. [phone|(020) 7946 0018] ask for the office", "fax [phone|415-555-0132] and then wait", "ring [phone|0151 555 0199] today",
    "write to [email|jörg.maß@post.example.de] or [email|zoë@mail.example.fr] soon", "the order of 12 items came to 3,450.00 in 2019",
    "on 12.03.2021 about 40 of 112 people left room 7", "chapter 3.4.1 of version 2.10 has 1200 words", "see page 42-44 and table 5",
    "code A-1234 weighs 55.7 kg + 3 more", "from 1990 to 1995 we sold 100+ boxes at 5% off", "the card [card|4000-0012-3456-7899] was lost",
    "reach [phone|+1 (212) 555-0187] [card|4556737586899855] thanks", "on [phone|+1 (305) 555-0142] [card|4716108999716531]",
    "both [card|4532015112830366] [phone|+1 (404) 555-0123] are hers", "at [ip|10.0.12.7] [phone|+1 (505) 555-0199] [ip|192.168.7.21]",
    "mail [email|pat.03@mail2.example.com] [card|4929254542287017] [email|kim.1@mail.example.com] then",
    "host [ip|10.20.30.40] replied", "user @ home wrote 3 notes", "id 8842913 has serial 00012 and key 77",
)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A start inside a run of digits fails or succeeds as the run's start does.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@+]")
# Between words: blanks, and marks that JSON, markup, query strings and tables put between values.
_BETWEEN = r"\x20\x09-\x0D\"'`{}\[\]<>|=&;"
_SPACE = re.compile(f"[{_BETWEEN}]")
_WORD = re.compile(f"[^{_BETWEEN}]+")
_TRAIL = ".,;:!?\"')]}>"
_LEAD = "\"'([{<"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, "@" and dotted domain: found from each "@", so long runs stay linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, in order."""
    spans = [(s, 0, e) for s, e in emails(text)]
    spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
              if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def shape(word: str) -> str:
    """Letters as X or x (runs once), digits as d with the length of their run, the rest as it is."""
    out: list[str] = []
    run = 0
    for c in word + "\0":
        if c in "0123456789":
            run += 1
            continue
        if run:
            out.append(f"d{run if run < 5 else 'M' if run < 14 else 'C' if run < 20 else 'L'}")
            run = 0
        if c != "\0":
            s = "X" if c.isupper() else "x" if c.isalpha() else c
            if not out or out[-1] != s:
                out.append(s)
    return "".join(out)


def coarse(word: str) -> str:
    digits = sum(c in "0123456789" for c in word)
    return ("@" if "@" in word else "+" if word[:1] == "+" else "d" if digits and digits * 2 >= len(word) else "m" if digits else "w") + (
        "." if word[-1:] in ".,;:!?" else "")


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Sequences of words (start, end): those within REACH of a marked word, merged where they touch."""
    marked, last = [], -1
    for m in _MARK.finditer(text):
        if m.start() >= last:
            s = m.start()
            while s and not _SPACE.match(text, s - 1):
                s -= 1
            end = _SPACE.search(text, m.start())
            last = end.start() if end else len(text)
            marked.append((s, last))
    out: list[list[tuple[int, int]]] = []
    for s, e in marked:
        before: list[tuple[int, int]] = []
        floor = out[-1][-1][1] if out else 0
        at = s
        while len(before) < REACH and at > floor:
            at -= 1
            if _SPACE.match(text, at):
                continue
            stop = at + 1
            while at > floor and not _SPACE.match(text, at - 1):
                at -= 1
            before.append((at, stop))
        after = []
        for m in _WORD.finditer(text, e):
            after.append((m.start(), m.end()))
            if len(after) == REACH:
                break
        if out and s < floor:  # already one of the words after the last mark
            known = {w: i for i, w in enumerate(out[-1])}
            out[-1] = out[-1][:known[(s, e)] + 1] + after
        elif out and len(before) < REACH and at <= floor:
            out[-1] += [*reversed(before), (s, e), *after]
        else:
            out.append([*reversed(before), (s, e), *after])
    return out


def features(words: list[str]) -> list[tuple[str, ...]]:
    shapes, classes = [shape(w.rstrip(_TRAIL)) for w in words], [coarse(w) for w in words]
    near = lambda items, i: items[i] if 0 <= i < len(items) else "|"
    return [("bias", f"s={shapes[i]}", f"c={classes[i]}", f"p={near(classes, i - 1)}", f"n={near(classes, i + 1)}",
             f"ps={near(shapes, i - 1) if near(classes, i - 1) != 'w' else 'w'}",
             f"ns={near(shapes, i + 1) if near(classes, i + 1) != 'w' else 'w'}") for i in range(len(words))]


def tags_of(words: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """Tag indexes of words by the spans they overlap, first span first."""
    out, previous = [], None
    for s, e in words:
        own = next((x for x in spans if x[0] < e and x[2] > s), None)
        out.append(0 if own is None else 1 + 2 * own[1] + (own is previous))
        previous = own
    return out


def allowed() -> np.ndarray:
    """Transitions of the tag scheme: an inside tag follows its own kind only."""
    ok = np.ones((len(TAGS), len(TAGS)), bool)
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            ok[:, j] = [t[1:] == tag[1:] for t in TAGS]
    return ok


_FORBIDDEN = -1e4


@dataclass
class Field:
    """Weights of the features for each tag, and of the transitions."""

    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray

    def emissions(self, sequence: list[tuple[str, ...]]) -> np.ndarray:
        ids = [[self.index.get(f, len(self.emit) - 1) for f in fs] for fs in sequence]
        return self.emit[np.array(ids)].sum(axis=1)

    def decode(self, sequences: list[list[tuple[str, ...]]]) -> list[list[int]]:
        """Best tags of each sequence; batches hold sequences of similar length."""
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        out: list[list[int]] = [[]] * len(sequences)
        at = 0
        while at < len(order):
            take, longest = at, 0
            while take < len(order) and (take == at or (take - at + 1) * len(sequences[order[take]]) <= CELLS):
                longest = len(sequences[order[take]])
                take += 1
            part = order[at:take]
            x = np.zeros((len(part), longest, len(TAGS)))
            lengths = np.array([len(sequences[i]) for i in part])
            for k, i in enumerate(part):
                x[k, :lengths[k]] = self.emissions(sequences[i])
            for i, tags, n in zip(part, viterbi(x, self.move, lengths), lengths):
                out[i] = tags[:n].tolist()
            at = take
        return out


def viterbi(x: np.ndarray, move: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best tag paths of padded emissions ``x`` (sequences, words, tags)."""
    n, steps, tags = x.shape
    best, back = x[:, 0] + np.array([_FORBIDDEN if t[0] == "I" else 0 for t in TAGS]), np.zeros((n, steps, tags), np.int16)
    for t in range(1, steps):
        scores = best[:, :, None] + move[None]
        back[:, t] = scores.argmax(axis=1)
        now = np.take_along_axis(scores, back[:, t][:, None, :].astype(np.int64), 1)[:, 0] + x[:, t]
        best = np.where((t < lengths)[:, None], now, best)
    path = np.zeros((n, steps), np.int64)
    tag = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        inside = t < lengths
        path[:, t] = np.where(inside, tag, 0)
        if t:
            tag = np.where(inside, back[np.arange(n), t, tag], tag)
    return path


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(table: list[tuple[list[str], list[int]]], *, rounds: int = 80, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam over the whole table."""
    sequences = [features(words) for words, _ in table]
    index: dict[str, int] = {}
    for sequence in sequences:
        for fs in sequence:
            for f in fs:
                index.setdefault(f, len(index))
    unknown, steps, tags = len(index), max(len(s) for s in sequences), len(TAGS)
    ids = np.full((len(sequences), steps, 7), unknown)
    gold = np.zeros((len(sequences), steps), np.int64)
    lengths = np.array([len(s) for s in sequences])
    for k, (sequence, (_, own)) in enumerate(zip(sequences, table)):
        ids[k, :len(sequence)] = [[index[f] for f in fs] for fs in sequence]
        gold[k, :len(own)] = own
    inside = np.arange(steps)[None] < lengths[:, None]
    emit, move = np.zeros((unknown + 1, tags)), np.zeros((tags, tags))
    block = np.where(allowed(), 0, _FORBIDDEN)
    first = np.array([_FORBIDDEN if t[0] == "I" else 0 for t in TAGS])
    params, m, v = [emit, move], [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)]
    rows, n = np.arange(len(sequences)), len(sequences)
    seen_move = np.zeros((tags, tags))
    both = inside[:, 1:]
    np.add.at(seen_move, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    seen, flat = np.eye(tags)[gold] * inside[..., None], ids[inside].ravel()
    for step in range(1, rounds + 1):
        x = emit[ids].sum(axis=2) * inside[..., None]
        full = move + block
        ahead = np.zeros((n, steps, tags))
        ahead[:, 0] = x[:, 0] + first
        for t in range(1, steps):
            ahead[:, t] = np.where(inside[:, t, None], _sum_exp(ahead[:, t - 1][:, :, None] + full[None], 1) + x[:, t], ahead[:, t - 1])
        behind = np.zeros((n, steps, tags))
        total = _sum_exp(ahead[rows, lengths - 1], 1)
        pairs = np.zeros((tags, tags))
        for t in range(steps - 2, -1, -1):
            on = inside[:, t + 1]
            nxt = x[:, t + 1] + behind[:, t + 1]
            behind[:, t] = np.where(on[:, None], _sum_exp(full[None] + nxt[:, None, :], 2), 0)
            joint = np.exp(np.minimum(ahead[:, t][:, :, None] + full[None] + nxt[:, None, :] - total[:, None, None], 0))
            pairs += joint[on].sum(axis=0)
        share = np.exp(np.minimum(ahead + behind - total[:, None, None], 0)) * inside[..., None]
        g_emit = np.zeros_like(emit)
        for j in range(tags):
            g_emit[:, j] = np.bincount(flat, np.repeat((share - seen)[inside][:, j], 7), unknown + 1)
        g_emit[unknown] = 0
        for i, g in enumerate((g_emit / n + decay * emit, (pairs - seen_move) / n + decay * move)):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            params[i] -= rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    return Field(index, emit, move + block)


def taught() -> list[tuple[list[str], list[int]]]:
    """The hand-tagged lines as (words, tags)."""
    table = []
    for line in TAUGHT:
        words, tags = [], []
        for part in re.findall(r"\[[a-z]+\|[^\]]+\]|\S+", line):
            tagged = re.fullmatch(r"\[([a-z]+)\|([^\]]+)\]", part)
            own = _WORD.findall(tagged.group(2) if tagged else part)
            kind = KINDS.index(tagged.group(1)) if tagged else None
            words += own
            tags += [0 if kind is None else 1 + 2 * kind + (i > 0) for i in range(len(own))]
        table.append((words, tags))
    return table


def labelled_table(docs: DataFrame, *, max_docs: int = MAX_DOCS, max_windows: int = MAX_WINDOWS) -> list[tuple[list[str], list[int]]]:
    """Windows of the documents with the smallest hashes of their id, tagged by the base, and the hand-tagged lines."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                sequences = [w[at:at + WORDS] for w in windows(text or "") for at in range(0, len(w), WORDS)]
                for words in sequences:
                    lo, hi = words[0][0], words[-1][1]
                    near = [x for x in base_spans(text[lo:hi])]
                    tags = tags_of([(s - lo, e - lo) for s, e in words], near)
                    own = [text[s:e] for s, e in words]
                    rows.append((own, tags, hashlib.md5(" ".join(own).encode("utf-8", "replace")).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                 pa.array([r[2] for r in rows], pa.string())], ["words", "tags", "h"])

    ids = docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    sample = docs.select("doc_id", "text").join(ids, "doc_id").select("text")
    got = sample.mapInArrow(cut, "words array<string>, tags array<int>, h string").orderBy("h").limit(max_windows).collect()
    return [(list(r["words"]), list(r["tags"])) for r in got] + 3 * taught()


def added_spans(text: str, words: list[tuple[int, int]], tags: list[int], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the decoded runs that overlap no base span, without surrounding punctuation."""
    out, k = [], 0
    while k < len(tags):
        if not tags[k]:
            k += 1
            continue
        kind, end = (tags[k] - 1) // 2, k + 1
        while end < len(tags) and tags[end] == 2 + 2 * kind:
            end += 1
        s, e = words[k][0], words[end - 1][1]
        while e > s and text[e - 1] in _TRAIL and text[e - 1] != ")":
            e -= 1
        while s < e and text[s] in _LEAD and text[s] != "(":
            s += 1
        if s < e and _MARK.search(text, s, e) and not any(a < e and b > s for a, _, b in base):
            out.append((s, kind, e))
        k = end
    return out


def find(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, counts and digest of the base spans, all spans, number of added spans."""
    out = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()),
                     ("spans", pa.string()), ("n_added", pa.int64())])

    def write(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, todo, sequences = [], [], []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                base = base_spans(text) if _MARK.search(text) else []
                found.append([base, []])
                if base or _MARK.search(text):
                    for words in windows(text):
                        todo.append((i, words))
                        sequences.append(features([text[s:e] for s, e in words]))
                if sum(map(len, sequences)) > CELLS or i + 1 == batch.num_rows:
                    for (k, words), tags in zip(todo, field.decode(sequences)):
                        if any(tags):
                            found[k][1] += added_spans(batch.column(1)[k].as_py(), words, tags, found[k][0])
                    todo, sequences = [], []
            rows = {n: [] for n in out.names}
            for doc_id, (base, more) in zip(batch.column(0).to_pylist(), found):
                rows["doc_id"].append(doc_id)
                for k, kind in enumerate(KINDS):
                    rows[f"n_{kind}"].append(sum(x[1] == k for x in base))
                rows["base_sha256"].append(hashlib.sha256(write(base).encode()).hexdigest())
                rows["spans"].append(write(sorted(base + more)))
                rows["n_added"].append(len(more))
            yield pa.RecordBatch.from_pydict(rows, schema=out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, ", ".join(["doc_id long", *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string", "n_added long"]))


def detect(docs: DataFrame, *, max_docs: int = MAX_DOCS) -> DataFrame:
    """The operator: train on the labelled table of ``docs`` and find the spans of every text."""
    return find(docs, train(labelled_table(docs, max_docs=max_docs)))


ship_by_value(__name__)
