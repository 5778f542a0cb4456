"""Small helpers of family models: progressive alignment, and scores of sequences against a model (numpy)."""

from __future__ import annotations

import numpy as np

from .align import GAP_EXTEND, GAP_OPEN, fill, path, spanning_end

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
#: Scores of averaged columns are kept as whole hundredths.
SCALE = 100
#: Word length of the distances that the guide tree follows.
WORD = 3
TRANSITIONS = ("mm", "mi", "md", "im", "ii", "dm", "dd")
NEVER = -1e30


def letter_scores(scores: dict[str, dict[str, int]]) -> np.ndarray:
    """Substitution scores by ASCII code; letters without one score -4."""
    table = np.full((128, 128), -4.0)
    for a, row in scores.items():
        for b, value in row.items():
            table[ord(a), ord(b)] = value
    return table


def word_distances(sequences: list[str]) -> np.ndarray:
    """One minus the share of the shorter sequence's words that the other one has too."""
    words = [{s[i : i + WORD] for i in range(len(s) - WORD + 1)} for s in sequences]
    n = len(words)
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(i):
            least = min(len(words[i]), len(words[j]))
            out[i, j] = out[j, i] = 1 - len(words[i] & words[j]) / least if least else float(sequences[i] != sequences[j])
    return out


def guide_tree(distances: np.ndarray) -> list[tuple[int, int]]:
    """Merges by average distance, the closest first, ties by number; the k-th merge makes node n + k."""
    n = len(distances)
    far = np.full((2 * n - 1, 2 * n - 1), np.inf)
    far[:n, :n] = np.round(distances, 12)
    far[np.arange(n), np.arange(n)] = np.inf
    size, merges = [1] * n, []
    for new in range(n, 2 * n - 1):
        a, b = divmod(int(np.argmin(far)), 2 * n - 1)
        merges.append((a, b))
        joined = (far[a] * size[a] + far[b] * size[b]) / (size[a] + size[b])
        joined[[a, b]] = np.inf
        far[[a, b]], far[:, [a, b]] = np.inf, np.inf
        far[new], far[:, new] = np.round(joined, 12), np.round(joined, 12)
        size.append(size[a] + size[b])
    return merges


def _shares(rows: np.ndarray) -> np.ndarray:
    """For each column the share of each ASCII letter; what is missing to 1 are gaps."""
    out = np.zeros((rows.shape[1], 128))
    for letter in np.unique(rows):
        if letter != ord("-"):
            out[:, letter] = (rows == letter).mean(axis=0)
    return out


def _joined(a: np.ndarray, b: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Two alignments (rows of codes) as one: columns are paired by their average scores, end gaps are free."""
    pairs = np.rint(SCALE * (_shares(a) @ table @ _shares(b).T)).astype(np.int64)
    best = fill(pairs, GAP_OPEN * SCALE, GAP_EXTEND * SCALE, False)
    columns = path(best, pairs, spanning_end(best), GAP_OPEN * SCALE, GAP_EXTEND * SCALE, False)
    used = [[x[s] for x in columns if x[s] >= 0] for s in (0, 1)]
    before = [(used[s][0] if used[s] else 0) for s in (0, 1)]
    after = [(used[s][-1] + 1 if used[s] else 0) for s in (0, 1)]
    columns = [(i, -1) for i in range(before[0])] + [(-1, j) for j in range(before[1])] + columns + [(i, -1) for i in range(after[0], a.shape[1])] + [(-1, j) for j in range(after[1], b.shape[1])]
    gap = ord("-")
    left, right = (np.concatenate([x, np.full((len(x), 1), gap, np.uint8)], axis=1) for x in (a, b))
    return np.concatenate([left[:, [i for i, _ in columns]], right[:, [j for _, j in columns]]])


def progressive(sequences: list[str], scores: dict[str, dict[str, int]]) -> list[str]:
    """The sequences as rows of one alignment, merged along a guide tree of word distances."""
    table = letter_scores(scores)
    parts = [(np.frombuffer(s.encode("ascii", "replace"), np.uint8)[None], [i]) for i, s in enumerate(sequences)]
    for a, b in guide_tree(word_distances(sequences)) if len(parts) > 1 else ():
        (x, i), (y, j) = parts[a], parts[b]
        parts.append((_joined(x, y, table), i + j))
    rows, order = parts[-1]
    return [rows[k].tobytes().decode() for k in np.argsort(order)]


def place(alignment: list[str], sequence: str, scores: dict[str, dict[str, int]]) -> str:
    """A sequence in the columns of an alignment: upper-case letters and '-' in its columns, lower-case ones between them."""
    rows = np.array([np.frombuffer(r.encode(), np.uint8) for r in alignment])
    own = np.frombuffer(sequence.encode("ascii", "replace"), np.uint8)
    n, m = rows.shape[1], len(own)
    if not n or not m:
        return "-" * n + sequence.lower()
    pairs = np.rint(SCALE * (_shares(rows) @ letter_scores(scores)[:, own])).astype(np.int64)
    best = fill(pairs, GAP_OPEN * SCALE, GAP_EXTEND * SCALE, False)
    columns = path(best, pairs, spanning_end(best), GAP_OPEN * SCALE, GAP_EXTEND * SCALE, False)
    cs, rs = [c for c, _ in columns if c >= 0], [r for _, r in columns if r >= 0]
    if not cs or not rs:
        return "-" * n + sequence.lower()
    body = "".join("-" if r < 0 else sequence[r].lower() if c < 0 else sequence[r].upper() for c, r in columns)
    return sequence[: rs[0]].lower() + "-" * cs[0] + body + "-" * (n - 1 - cs[-1]) + sequence[rs[-1] + 1 :].lower()


def log_model(emissions: np.ndarray, transitions: np.ndarray, background: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the residues of each match state (the last column, 0, for other letters), and log transitions."""
    odds = np.log(np.maximum(emissions, 1e-300) / background)
    return np.concatenate([odds, np.zeros((len(odds), 1))], axis=1), np.log(np.maximum(transitions, 1e-300))


def search(odds: np.ndarray, logs: np.ndarray, sequences: list[str]) -> dict[str, np.ndarray]:
    """Best local path of each sequence through a model, and the sum over all paths, in bits.

    A path begins in any match state at any residue (each of the
    L (L + 1) / 2 fragments of the model equally likely), ends in any, and
    passes match, insert and delete states; residues outside it and inserts
    score 0.  Places are counted from 1; of equal scores the path that ends
    first wins.
    """
    length, n = len(odds), len(sequences)
    longest = max(map(len, sequences), default=0)
    codes = np.full((n, longest), 20, np.int64)
    letters = np.full(256, 20, np.int64)
    for i, c in enumerate(RESIDUES):
        letters[ord(c)] = letters[ord(c.lower())] = i
    sizes = np.array([len(s) for s in sequences], np.int64)
    for row, s in zip(codes, sequences, strict=True):
        row[: len(s)] = letters[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
    mm, mi, md, im, ii, dm, dd = (logs[:, i] for i in range(7))
    enter = -np.log(length * (length + 1) / 2)
    states = lambda: np.full((n, length), NEVER)
    m, i_, d, fm, fi, fd = (states() for _ in range(6))
    begun = [np.zeros((n, length), np.int64) for _ in range(3)]  # where the best path to each state began: residue * length + state
    best, total = np.full(n, NEVER), np.full(n, NEVER)
    found = np.zeros((n, 4), np.int64)
    run_dd = np.concatenate([[0.0], np.cumsum(dd[:-1])])  # a chain of deletes is a running maximum once these are taken off

    def shifted(x: np.ndarray, more: np.ndarray) -> np.ndarray:
        out = np.full_like(x, NEVER)
        out[:, 1:] = x[:, :-1] + more[:-1]
        return out

    def moved(x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        out[:, 1:] = x[:, :-1]
        return out

    columns = np.arange(length)
    for t in range(longest):
        here = odds[:, codes[:, t]].T
        live = (t < sizes)[:, None]
        ways = np.stack([shifted(m, mm), shifted(i_, im), shifted(d, dm), np.full((n, length), enter)])
        pick = ways.argmax(axis=0)
        start = np.choose(pick, [moved(begun[0]), moved(begun[1]), moved(begun[2]), np.broadcast_to(t * length + columns, (n, length))])
        stay, open_ = i_ + ii, m + mi
        new_i, start_i = np.maximum(open_, stay), np.where(open_ >= stay, begun[0], begun[1])
        m = np.where(live, here + ways.max(axis=0), NEVER)
        i_ = np.where(live, new_i, NEVER)
        from_m = shifted(m, md) - run_dd
        top = np.maximum.accumulate(from_m, axis=1)
        at = np.maximum.accumulate(np.where(from_m == top, columns, 0), axis=1)
        d = top + run_dd
        begun = [start, start_i, np.take_along_axis(moved(start), at, axis=1)]
        ends = m.argmax(axis=1)
        score = m[np.arange(n), ends]
        better = score > best
        best = np.where(better, score, best)
        first = start[np.arange(n), ends]
        found[better] = np.stack([first % length + 1, ends + 1, first // length + 1, np.full(n, t + 1)], 1)[better]
        # the same sums over all paths
        ways = np.logaddexp(np.logaddexp(shifted(fm, mm), shifted(fi, im)), np.logaddexp(shifted(fd, dm), enter))
        new_i = np.logaddexp(fm + mi, fi + ii)
        fm = np.where(live, here + ways, NEVER)
        fi = np.where(live, new_i, NEVER)
        fd = np.logaddexp.accumulate(shifted(fm, md) - run_dd, axis=1) + run_dd
        total = np.logaddexp(total, np.logaddexp.reduce(fm, axis=1))
    bits = np.log(2)
    return {"score": best / bits, "forward": total / bits, "hmm_from": found[:, 0], "hmm_to": found[:, 1], "seq_from": found[:, 2], "seq_to": found[:, 3]}
