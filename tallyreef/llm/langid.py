"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

_ROOT_FLAG = np.int32(-(2**31))


def _fold_char(c: str) -> str:
    """Letters in lower case; everything else is a blank."""
    low = c.lower()[:1]
    return low if unicodedata.category(low)[0] == "L" else " "


#: Letters beyond the most frequent ones are spelled with this many digits of this base, which covers all code points.
DIGITS, BASE = 4, 33


class Alphabet:
    """Symbols of texts: 0 for letters that no text has, 1 for blanks and other marks, further numbers for letters.

    The most frequent letters of the texts get symbols of their own, each with its upper case. Where texts have more letters
    than that, every other letter is spelled with DIGITS symbols for its code point, so that all letters stay apart and the
    width, the number of symbols, is bounded.
    """

    def __init__(self, texts: list[str], most: int = 62):
        counts: dict[str, int] = {}
        for t in texts:
            for c in t:
                counts[c] = counts.get(c, 0) + 1
        letters: dict[str, int] = {}
        for c, n in counts.items():
            if (f := _fold_char(c)) != " ":
                letters[f] = letters.get(f, 0) + n
        ranked = sorted(letters, key=lambda c: (-letters[c], c))
        self.first = len(ranked[:most]) + 2 if len(ranked) > most else 0  # of the digits; 0 where there are none
        self.width = self.first + BASE if self.first else len(ranked) + 2
        self.own = np.zeros(0x110000, dtype=np.uint8)
        for p in range(0x110000):
            if unicodedata.category(chr(p))[0] != "L":
                self.own[p] = 1
        for k, c in enumerate(ranked[:most]):
            self.own[ord(c)] = k + 2
            if len(c.upper()) == 1:
                self.own[ord(c.upper())] = k + 2

    def spelled(self, text: str) -> np.ndarray:
        """Symbols of a text, with runs of blanks as one."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        s = self.own[points]
        if self.first and len(rare := np.flatnonzero(s == 0)):
            folded = {p: ord(_fold_char(chr(p))) for p in np.unique(points[rare]).tolist()}
            code = np.array([folded[p] for p in points[rare].tolist()], dtype=np.int64)
            times = np.ones(len(s), dtype=np.int64)
            times[rare] = DIGITS
            begin = (np.cumsum(times) - times)[rare]
            s = np.repeat(s, times)
            for k in range(DIGITS):
                s[begin + k] = self.first + code // BASE ** (DIGITS - 1 - k) % BASE
        if len(s):
            held = np.ones(len(s), dtype=bool)
            held[1:] = (s[1:] != 1) | (s[:-1] != 1)
            s = s[held]
        return s


def automaton(s: np.ndarray, width: int) -> np.ndarray:
    """Transitions of the suffix automaton of s, one row for each state; -1 where a factor ends."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in s.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    out = np.full((len(nxt), width), -1, dtype=np.int32)
    for k, row in enumerate(nxt):
        for c, to in row.items():
            out[k, c] = to
    return out


class Model:
    """Suffix automata of labelled text, one for each language, in one table of transitions.

    An entry holds the row offset of the next state. Where no factor goes on, the entry leads on from the root, with the
    sign bit set: there the next phrase begins, with the same symbol. One state more stands before the first phrase and
    after a symbol that the language never has, which is a phrase by itself; all its entries begin a phrase.
    """

    def __init__(self, samples: dict[str, list[str]], chars: int):
        self.langs = sorted(samples)
        self.alphabet = Alphabet([t for ts in samples.values() for t in ts])
        self.width = self.alphabet.width
        tables, self.roots, self.sizes, base = [], [], [], 0
        for lang in self.langs:
            joined = [self.alphabet.spelled(t) for t in samples[lang]]
            s = np.concatenate([x for t in joined for x in (t, [0])] or [np.zeros(0)])[:chars].astype(np.int64)
            own = automaton(s[s > 0], self.width)
            begin = np.where(own[0] >= 0, own[0], len(own))[None, :]
            step = np.concatenate([np.where(own >= 0, own, begin), begin])
            table = ((step + base) * self.width).astype(np.int32)
            table |= np.concatenate([np.where(own >= 0, 0, _ROOT_FLAG), np.full_like(begin, _ROOT_FLAG)]).astype(np.int32)
            tables.append(table)
            self.roots.append((base + len(own)) * self.width)
            self.sizes.append(max(2, int((s > 0).sum())))
            base += len(own) + 1
        self.table = np.concatenate([t.reshape(-1) for t in tables]) if tables else np.zeros(0, dtype=np.int32)

    def phrases(self, texts: list[str], piece: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that each language needs for each whole text (texts x languages), and the symbols of each text.

        Texts are cut into pieces of so many symbols, which are parsed side by side, each from the root; a cut costs every
        language the same one phrase at most.
        """
        spelt = [self.alphabet.spelled(t) for t in texts]
        sizes = np.fromiter(map(len, spelt), dtype=np.int64, count=len(spelt))
        n_pieces = -(-sizes // piece)
        owner = np.repeat(np.arange(len(texts)), n_pieces)
        if not len(owner):
            return np.zeros((len(texts), len(self.langs))), sizes
        first = np.repeat(np.cumsum(sizes) - sizes, n_pieces) + (np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)) * piece
        end = np.minimum(first + piece, np.repeat(np.cumsum(sizes), n_pieces))
        flat = np.concatenate(spelt)
        long = np.argsort(first - end, kind="stable")
        first, width = first[long], (end - first)[long]
        count = np.zeros((len(self.langs), len(owner)), dtype=np.int32)
        state = np.repeat(np.array(self.roots, dtype=np.int32)[:, None], len(owner), axis=1)
        live = np.searchsorted(-width, -np.arange(piece), side="left")  # pieces longer than each step
        grid = np.zeros((piece, len(owner)), dtype=np.int32)
        inside = np.arange(piece)[:, None] < width
        grid[inside] = flat[(first + np.arange(piece)[:, None])[inside]]
        keep_bits = np.int32(0x7FFFFFFF)
        for t in range(piece):
            m = live[t]
            if not m:
                break
            got = self.table[state[:, :m] + grid[t, :m]]
            count[:, :m] -= got >> 31
            np.bitwise_and(got, keep_bits, out=state[:, :m])
        out = np.zeros((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner[long], weights=count[k], minlength=len(texts))
        return out, sizes


def train(labelled: DataFrame, chars: int = 60_000, texts: int = 64, prefix: int = 4000, total: int = 480_000, languages: int = 10_000, id_column: str = "doc_id") -> Model:
    """Fit on a bounded sample of rows with text and lang: for every language the texts rows least by hash of the id, of
    each so many leading characters, and of all these so many symbols.

    The sample is found from ids and languages alone; only its own texts are read after that. The automata of a language
    take at most 2 * chars states, and those of all languages 2 * total: more than total // chars languages share
    the total evenly. More languages than the bound are refused. Null and empty texts and null languages teach nothing.
    """
    known = labelled.where("text IS NOT NULL AND lang IS NOT NULL AND length(text) > 0")
    counted = known.groupBy("lang").agg(F.count("*").alias("n")).limit(languages + 1).collect()
    if len(counted) > languages:
        raise ValueError(f"the labelled rows have over {languages} languages")
    chars = min(chars, total // max(1, len(counted)))
    prefix = min(prefix, max(64, 5 * chars // texts))
    counts = labelled.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in counted], "lang string, n long")
    # ids of least hash: a threshold leaves a few more than are wanted, so that no task ranks a whole language
    low = F.pmod(F.xxhash64(F.col(id_column), F.lit(5)), F.lit(1 << 30))
    some = known.select(id_column, "lang").join(F.broadcast(counts), "lang").withColumn("low", low).where(F.col("low") < F.least(F.lit(1.0), F.lit(2.0 * texts + 100) / F.col("n")) * F.lit(1 << 30))
    order = Window.partitionBy("lang").orderBy("low", id_column)
    picked = some.withColumn("rank_", F.row_number().over(order)).where(F.col("rank_") <= texts)
    chosen = known.join(F.broadcast(picked.select(id_column).distinct()), id_column).select("lang", id_column, F.substring("text", 1, prefix).alias("text"))
    samples: dict[str, list[str]] = {}
    for row in sorted(chosen.collect(), key=lambda r: (r["lang"], r[id_column])):
        samples.setdefault(row["lang"], []).append(row["text"])
    return Model(samples, chars)


def identify(docs: DataFrame, model: Model, carry: list[str], text: str = "text") -> DataFrame:
    """The carry columns with lang_pred, score and bits of every whole text.

    The language whose automaton needs the fewest phrases, each taken as log2 of its sample's size, wins; ties go to the
    language first by name. score is the winner's share when each language weighs two to the minus its bits. Null texts, texts without a letter and an empty model give `und` with score 0. Copies
    get equal results; further columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    cost = np.log2(np.array(model.sizes, dtype=float)) if model.langs else np.zeros(0)

    def run(batches):
        m = sent.value
        for pdf in C.slabs(batches, name, 1_000_000):
            texts, pdf = C.texts_of(pdf[name]), pdf if text in carry else pdf.drop(columns=name)
            lettered = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool)
            if not m.langs:
                yield pdf.assign(lang_pred="und", score=0.0, bits=0.0)
                continue
            counts, sizes = m.phrases(texts)
            bits = counts * cost
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(texts)), best]
            share = 1.0 / np.exp2(-np.minimum(bits - least[:, None], 60.0)).sum(axis=1)
            langs = np.where(lettered, np.array(m.langs, dtype=object)[best], "und")
            yield pdf.assign(lang_pred=langs, score=np.where(lettered, share, 0.0), bits=least / np.maximum(sizes, 1))

    name = text if text in carry else "text_"
    chosen = docs.select(*carry, *([] if text in carry else [F.col(text).alias(name)]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name in carry)
    return chosen.mapInPandas(run, schema + ", lang_pred string, score double, bits double")
