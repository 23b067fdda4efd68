"""Per-document text quality statistics, and prose told from lists, tables and junk.

All counts of a batch of texts are made at once on arrays of code points: a
table gives each code point's class, sums between line starts give the counts
of lines, and the hashes of all words come from one running sum.

Two Gaussian mixtures are fitted by expectation-maximization: one to the
standardized statistics of documents, one, as its supplement, to those of
lines, short lines together with their neighbours. Both see the whole corpus
as a bounded summary, the numbers (and for documents the sums) of a fixed
number of cells. Components are named by inspected examples. A document's
mixture gives the odds of each kind for its lines, a line's own statistics
outweigh them where they are clear, and a document is what most of its
characters are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import checkpointed, spread, table
from .batches import slices

_LETTER, _DIGIT, _BLANK, _BREAK, _POINT, _SYMBOL = range(6)
#: Punctuation of sentences, which doesn't count as symbols, and line ends among it.
_POINTS = ".,;:!?'\"()-–—’‘“”„«»…"
_ENDS = ".!?…\"”»’)]"
_BASE = np.uint64(0x9E3779B97F4A7C15)

#: Upper edges of the cells of each line statistic.
EDGES = {
    "common": [0.02, 0.06, 0.12, 0.18, 0.25, 0.35, 0.5],
    "symbols": [0.003, 0.015, 0.04, 0.08, 0.15, 0.3, 0.5],
    "digits": [0.01, 0.04, 0.08, 0.15, 0.25, 0.4, 0.6],
    "word_length": [2.0, 3.0, 4.0, 5.0, 6.0, 7.5, 10.0],
}
CELLS = 8 ** len(EDGES)
#: Upper edges of the cells of each document statistic; ended is the share of lines that end in punctuation.
DOCUMENT_EDGES = {
    "common": [0.05, 0.12, 0.2, 0.3, 0.4],
    "symbols": [0.003, 0.02, 0.06, 0.15, 0.3],
    "digits": [0.01, 0.05, 0.12, 0.25, 0.5],
    "word_length": [2.5, 4.0, 5.0, 6.5, 9.0],
    "ended": [0.05, 0.2, 0.4, 0.6, 0.9],
}
CLASSES = ("prose", "list", "table", "junk")
#: The mixtures are fitted until the log likelihood of a point grows by less than this, in no more rounds than that.
CONVERGED, ROUNDS = 1e-7, 2000
#: Weight of even odds beside a document's own: a line that is clear by itself is judged by itself.
EVEN = 1.0
#: Starting variance, least variance (in squared deviations) and weight of its start in a component (in shares of all lines).
START_VARIANCE, FLOOR, PRIOR = 0.3, 0.3, 1e-4
#: Lines up to this many characters are judged together with their neighbours.
SHORT = 120

#: Inspected examples of each class, by which components are named.
EXAMPLES = {
    "prose": [
        "The committee examined the proposal and each member of the council supported that measure.",
        "We thank the minister for this answer, but our farmers are still waiting for the promised reform.",
        "OF 310 CASES THE AGENCY ANSWERED ONLY 12, AND THE REST WERE LEFT TO THE COURTS.",
        "In 2014 the board of the harbour approved this plan by 48 votes, although the report was late.",
        "Die Regierung prüfte den Antrag und das Gericht bestätigte die neue Regelung für das Land.",
        "Niemand bestritt offen die wichtige Frage, weil der Ausschuss das Ergebnis schon kannte.",
        "La commission examina la proposition et le ministre confirma la réforme avec les régions.",
        "Nous savons que la dette de la commune retarda la réponse du conseil pour 12 millions.",
        "Because that duty of the port was unclear,\nthe ministry revised its order and the\ncourt repealed each rule.",
    ],
    "list": [
        "1. National budget Westmoor\n2. Urban housing Oldgate\n3. Rural railway Kingsholt",
        "1. Neue Straße Altberg\n2. Alte Brücke Neustadt\n3. Gute Schule Bergholt",
        "Marlow, T.\nHansen, B.\nKeller, R.\nDubois, M.\nWinter-Lang, S.",
        "Marlow Tom; Hansen Berta; Keller Rolf; Dubois Marie; Winter Susanne;",
        "- Doc. 12/345 market\n• Doc. 77/1290 levy\n* Doc. 31/8 court",
        "budget forest 212 / 1\nbudget forest 212 / 2\nbudget forest 212 / 3",
        "Budget ................ 12\nMarket ........... 145\nRailway ................. 220",
    ],
    "table": [
        "Westmoor\t4521\t88213\t9034\nOldgate\t1290\t5521\t34120\nKingsholt\t77\t4312\t9921",
        "| market | 4521 | 12 | 88.10 |\n| levy | 129 | 341 | 9.45 |\n| court | 7712 | 90 | 12.07 |",
        '<td class="c1">4521</td><td>&nbsp;</td>\n<td class="c2">129</td><td>&nbsp;</td>',
        "Region   2013   2014   2015\nNorth   4521   4710   4433\nSouth   1209   1377   1298",
    ],
    "junk": [
        "##########\n==========\n**********",
        "k{x|;q/0 ~w,b}\\z>:p <m^o1 ¦c|\n;v{r\\0,x~ q/b>k:}z w|",
        "Ã©ï¿½Ã¼ Â§â€™Ã¤ ï¿½qt\nÃ¤Â§Ã© ï¿½ï¿½ xrÃ¼",
        "Home > News > Search > Help\nNext · Back · Contents · Index\n[menu] [close] [login]",
        "Share | Print | Save | Top\nShare | Print | Save | Top",
        "aGVsbG8gd29ybGQ/3Jk+QmFzZTY0\nZGF0YSBpbiBsaW5lcw9vPq+x",
    ],
}


@lru_cache(maxsize=1)
def _code_points() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, folded letter and sentence-ending flag of each code point below 65536."""
    kind, fold = np.full(65536, _SYMBOL, np.uint8), np.arange(65536, dtype=np.uint32)
    ends = np.zeros(65536, bool)
    for i in range(65536):
        c = chr(i)
        cat = unicodedata.category(c)
        if cat[0] in "LM":
            kind[i] = _LETTER
            low = unicodedata.normalize("NFKD", c.lower())
            fold[i] = ord(low[0]) if low else i
        elif cat[0] == "N":
            kind[i] = _DIGIT
        elif cat[0] in "ZC":
            kind[i] = _BLANK
    for c in "\n\r":
        kind[ord(c)] = _BREAK
    for c in _POINTS:
        kind[ord(c)] = _POINT
    for c in _ENDS:
        ends[ord(c)] = True
    return kind, fold, ends


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2 ** 64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words between ``starts`` and ``ends``, equal for equal words wherever they stand."""
    size = 1 << max(10, int(len(points)).bit_length())
    power, inverse = _powers(size)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points.astype(np.uint64) * power[: len(points)], dtype=np.uint64)])
    return (total[ends] - total[starts]) * inverse[starts]


def common_hashes(words: list[str]) -> np.ndarray:
    """Sorted hashes of the common words, without case and accents."""
    fold = _code_points()[1]
    out = []
    for w in words:
        p = fold[np.array([min(ord(c), 65535) for c in unicodedata.normalize("NFC", w)], np.int64)]
        out.append(word_hashes(p, np.array([0]), np.array([len(p)]))[0])
    return np.unique(np.array(out, np.uint64))


class Counts:
    """Counts of all non-blank lines of a batch of texts; ``doc`` numbers each line's text."""

    def __init__(self, texts: list[str | None], common: np.ndarray):
        kinds, fold, ends = _code_points()
        joined = "\n".join([t or "" for t in texts]) + "\n"
        p = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t or "") + 1 for t in texts])
        begins = np.concatenate([[0], np.cumsum(lengths)])
        if len(p) and p.max() >= 65536:
            high = np.flatnonzero(p >= 65536)
            p = p.copy()
            letters = [unicodedata.category(chr(c))[0] for c in p[high]]
            p[high] = [ord("x") if c in "LM" else ord("0") if c == "N" else ord("#") for c in letters]
        kind = kinds[p]
        is_break = kind == _BREAK
        line_of_break = np.flatnonzero(is_break)
        starts = np.concatenate([[0], line_of_break[:-1] + 1])
        inside = (kind == _LETTER) | (kind == _DIGIT)
        edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        ws, we = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        h = word_hashes(fold[p], ws, we)
        at = np.minimum(np.searchsorted(common, h), max(0, len(common) - 1))
        is_common = common[at] == h if len(common) else np.zeros(len(h), bool)
        # A single letter tells little about a line: wrongly decoded text is full of them.
        telling = is_common & (we - ws > 1)
        n = len(starts)
        line_of_word = np.searchsorted(starts, ws, side="right") - 1
        per_line = lambda mask: np.add.reduceat(mask.astype(np.int32), starts)
        per_word = lambda mask: np.bincount(line_of_word[mask], minlength=n)
        visible = (kind != _BLANK) & ~is_break
        self.chars = per_line(~is_break)
        solid = per_line(visible)
        self.letters = per_line(inside)
        self.digits = per_line(kind == _DIGIT)
        self.symbols = per_line(kind == _SYMBOL)
        # Runs of three or more points, as leaders are, count as symbols for the kind of a line.
        point = (kind == _POINT) & (p == ord("."))
        run = point.copy()
        run[2:] &= point[1:-1] & point[:-2]
        run[:2] = False
        self.leaders = per_line(run)
        self.words = np.bincount(line_of_word, minlength=n)
        self.common = per_word(is_common)
        self.telling = per_word(telling)
        last = np.maximum.reduceat(np.where(visible, np.arange(len(p)), 0), starts)
        self.ended = ends[p[last]] & (solid > 0)
        self.doc = np.searchsorted(begins, starts, side="right") - 1
        keep = solid > 0
        for name in ("chars", "letters", "digits", "symbols", "leaders", "words", "common", "telling", "ended", "doc"):
            setattr(self, name, getattr(self, name)[keep])
        self.n_docs = len(texts)

    def by_doc(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, x, minlength=self.n_docs).astype(np.int64)

    def statistics(self) -> list[np.ndarray]:
        """The statistics of EDGES for each line, short lines with their neighbours."""
        n = len(self.doc)
        columns = np.stack([self.chars, self.words, self.telling, self.symbols + self.leaders, self.digits, self.letters]).astype(np.float64)
        total = columns.copy()
        if n > 1:
            near = (self.doc[1:] == self.doc[:-1]) & (self.chars[1:] <= SHORT) & (self.chars[:-1] <= SHORT)
            total[:, 1:] += columns[:, :-1] * near
            total[:, :-1] += columns[:, 1:] * near
        chars, words, common, symbols, digits, letters = total
        chars, some = np.maximum(chars, 1), np.maximum(words, 1)
        return [common / some, symbols / chars, digits / chars, letters / some]

    def cells(self) -> np.ndarray:
        """The cell of each line."""
        out = np.zeros(len(self.doc), np.int64)
        for x, edges in zip(self.statistics(), EDGES.values()):
            out = out * 8 + np.searchsorted(edges, x)
        return out


def _analyser(common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            c = Counts(b.column(1).to_pylist(), common)
            begins = np.concatenate([[0], np.cumsum(np.bincount(c.doc, minlength=b.num_rows))]).astype(np.int32)
            nested = lambda x, t: pa.ListArray.from_arrays(pa.array(begins), pa.array(x, t))
            sums = [c.by_doc(x) for x in (c.chars, c.words, c.letters, c.symbols, c.ended, c.common, c.digits)]
            lines = np.bincount(c.doc, minlength=b.num_rows)
            names = ["doc_id", "n_chars", "n_words", "n_letters", "n_symbols", "n_ended", "n_common", "n_digits", "n_lines", "cells", "widths"]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, sums), pa.array(lines), nested(c.cells(), pa.int32()), nested(c.chars, pa.int32())], names=names)

    return run


def analyse(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """Counts of every document, and the cell and width of each of its lines.

    ``documents`` needs doc_id and text. Null and blank texts have no lines and
    counts of 0. The list of common words is a small fixed table; null words
    are left out, and their languages are taken together.
    """
    common = common_hashes([r.word for r in common_words.select("word").where("word is not null").distinct().collect()])
    schema = "doc_id long, n_chars long, n_words long, n_letters long, n_symbols long, n_ended long, n_common long, n_digits long, n_lines long, cells array<int>, widths array<int>"
    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(_analyser(common), schema)


def statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """Per document: word count, mean word length, shares of symbols, of lines ended by punctuation and of common words.

    Shares of documents without words, characters or lines are null.
    """
    a = analyse(documents, common_words)
    share = lambda x, n: F.try_divide(F.col(x), F.col(n))
    return a.select(
        "doc_id", "n_words", "n_lines",
        share("n_letters", "n_words").alias("mean_word_length"), share("n_symbols", "n_chars").alias("symbol_share"),
        share("n_ended", "n_lines").alias("ended_share"), share("n_common", "n_words").alias("common_share"),
    )


def _centres() -> np.ndarray:
    """The middle of each cell."""
    axes = []
    for name, e in EDGES.items():
        top = 1.0 if name != "word_length" else 14.0
        axes.append([e[0] / 2, *[(x + y) / 2 for x, y in zip(e, e[1:])], (e[-1] + top) / 2])
    return np.stack([g.ravel() for g in np.meshgrid(*axes, indexing="ij")], axis=1)


def _example_points(common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean statistics of each inspected example, and its class."""
    centres, points, classes = _centres(), [], []
    for c, name in enumerate(CLASSES):
        for text in EXAMPLES[name]:
            points.append(centres[Counts([text], common).cells()].mean(0))
            classes.append(c)
    return np.array(points), np.array(classes)


class Mixture:
    """A Gaussian mixture of independent statistics, standardized by their mean and deviation over all points.

    ``counts`` weighs the points. A component starts at each of ``starts``;
    variances have a floor, so that a component of equal points stays proper,
    and a little of its start stays in each, so that none dies out or wanders
    off to another kind.
    """

    def __init__(self, points: np.ndarray, counts: np.ndarray, starts: np.ndarray, deviation: np.ndarray | None = None):
        w = counts / counts.sum()
        self.mean = (points * w[:, None]).sum(0)
        self.deviation = np.sqrt(((points - self.mean) ** 2 * w[:, None]).sum(0)) + 1e-6 if deviation is None else deviation
        z, origin = self.standard(points), self.standard(starts)
        self.mu, self.var, self.pi = origin, np.full(origin.shape, START_VARIANCE), np.full(len(starts), 1 / len(starts))
        before, self.rounds = -np.inf, 0
        while self.rounds < ROUNDS:
            self.rounds += 1
            logs = self._logs(z)
            top = logs.max(1, keepdims=True)
            r = np.exp(logs - top)
            total = r.sum(1, keepdims=True)
            likelihood = float((w * (np.log(total) + top)[:, 0]).sum())
            r *= w[:, None] / total
            n = r.sum(0) + PRIOR
            mu = (r.T @ z + PRIOR * origin) / n[:, None]
            self.var = np.maximum((r.T @ z**2 + PRIOR * (mu**2 + self.var)) / n[:, None] - mu**2, FLOOR)
            self.mu, self.pi = mu, n / n.sum()
            if likelihood - before < CONVERGED:
                break
            before = likelihood

    def standard(self, points: np.ndarray) -> np.ndarray:
        return (points - self.mean) / self.deviation

    def _logs(self, z: np.ndarray) -> np.ndarray:
        return np.log(self.pi) - 0.5 * (np.log(self.var).sum(1) + (((z[:, None, :] - self.mu) ** 2) / self.var).sum(2))

    def responsibilities(self, points: np.ndarray) -> np.ndarray:
        logs = self._logs(self.standard(points))
        r = np.exp(logs - logs.max(1, keepdims=True))
        return r / r.sum(1, keepdims=True)


def name_components(of_examples: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The class of each component: what the examples are that it explains, each class counting alike.

    A component that explains none is what its own start is.
    """
    votes = np.stack([of_examples[classes == c].mean(0) for c in range(len(CLASSES))], axis=1)
    return np.where(votes.max(1) > 0.01, votes.argmax(1), classes)


def by_class(responsibilities: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The probability of each class, points by classes."""
    return np.stack([responsibilities[:, label == c].sum(1) for c in range(len(CLASSES))], axis=1)


def line_odds(counts: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, Mixture]:
    """The probability of each class in each cell of lines, and the mixture that gives it."""
    centres, used = _centres(), counts > 0
    starts, classes = _example_points(common)
    mixture = Mixture(centres[used], counts[used].astype(float), starts)
    r = mixture.responsibilities(centres)
    nearest = ((starts[:, None, :] - centres) ** 2 / centres.var(0)).sum(2).argmin(1)
    return by_class(r, name_components(r[nearest], classes)), mixture


def _document_points(counts: list[np.ndarray]) -> np.ndarray:
    """The statistics of DOCUMENT_EDGES from chars, words, letters, symbols, ended, common, digits and lines."""
    chars, words, letters, symbols, ended, common, digits, lines = (np.asarray(x, float) for x in counts)
    some, solid, rows = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    return np.stack([common / some, symbols / solid, digits / solid, letters / some, ended / rows], axis=1)


_COUNTS = ("n_chars", "n_words", "n_letters", "n_symbols", "n_ended", "n_common", "n_digits", "n_lines")


def document_mixture(analysed: DataFrame, common: np.ndarray) -> tuple[Mixture, np.ndarray]:
    """The mixture of document statistics and the class of each of its components.

    It is fitted to the means of the documents of each of 6 ** 5 cells; only
    those come to the driver.
    """
    some = lambda c: F.greatest(F.col(c), F.lit(1))
    shares = {"common": F.col("n_common") / some("n_words"), "symbols": F.col("n_symbols") / some("n_chars"), "digits": F.col("n_digits") / some("n_chars"), "word_length": F.col("n_letters") / some("n_words"), "ended": F.col("n_ended") / some("n_lines")}
    stats = analysed.where("n_lines > 0").select(*[shares[c].alias(c) for c in DOCUMENT_EDGES])
    cell = sum((sum((F.col(c) > e).cast("int") for e in edges) * 6**k for k, (c, edges) in enumerate(DOCUMENT_EDGES.items())), F.lit(0))
    rows = stats.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in DOCUMENT_EDGES], *[F.sum(F.col(c) ** 2).alias(f"{c}_2") for c in DOCUMENT_EDGES]).collect()
    n = np.array([r.n for r in rows], float)
    sums, squares = (np.array([[r[f"{c}{x}"] for c in DOCUMENT_EDGES] for r in rows]) for x in ("", "_2"))
    mean = sums.sum(0) / n.sum()
    deviation = np.sqrt(np.maximum(squares.sum(0) / n.sum() - mean**2, 0)) + 1e-6
    texts, classes = zip(*[(text, c) for c, name in enumerate(CLASSES) for text in EXAMPLES[name]])
    counted = Counts(list(texts), common)
    starts = _document_points([*[counted.by_doc(x) for x in (counted.chars, counted.words, counted.letters, counted.symbols, counted.ended, counted.common, counted.digits)], np.bincount(counted.doc, minlength=len(texts))])
    mixture = Mixture(sums / n[:, None], n, starts, deviation)
    return mixture, name_components(mixture.responsibilities(starts), np.array(classes))


def _judge(odds: np.ndarray, mixture: Mixture, label: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, widths = b.column("cells"), b.column("widths")
            counts = [b.column(c).to_numpy(zero_copy_only=False) for c in _COUNTS]
            own = by_class(mixture.responsibilities(_document_points(counts)), label) if b.num_rows else np.zeros((0, len(CLASSES)))
            doc = np.repeat(np.arange(b.num_rows), np.diff(cells.offsets.to_numpy()))
            prior = (own + EVEN / len(CLASSES)) / (1 + EVEN)
            kinds = (odds[cells.flatten().to_numpy(zero_copy_only=False)] * prior[doc]).argmax(1)
            w = widths.flatten().to_numpy(zero_copy_only=False)
            sums = [np.bincount(doc[kinds == c], w[kinds == c], minlength=b.num_rows).astype(np.int64) for c in range(len(CLASSES))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, sums), pa.array(own[:, 0])], names=["doc_id", *[f"{c}_chars" for c in CLASSES], "prose_odds"])

    return run


def classify(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """Per document the characters in prose, list, table and junk lines, ``prose_odds`` and ``kind``.

    ``prose_odds`` is what the mixture of document statistics gives prose.
    ``kind`` is ``prose`` unless more than half of the characters are in other
    lines, then the most frequent of the others. Blank texts have null.
    The analysis is written once to the shared folder; the mixtures are fitted
    on the counts of a fixed number of cells, whatever the size of the corpus.
    """
    a = checkpointed(analyse(documents, common_words))
    counts = np.zeros(CELLS, np.int64)
    for r in a.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect():
        counts[r.cell] = r["count"]
    schema = "doc_id long, " + ", ".join(f"{c}_chars long" for c in CLASSES)
    if counts.any():
        common = common_hashes([r.word for r in common_words.select("word").where("word is not null").distinct().collect()])
        judged = a.select("doc_id", "cells", "widths", *_COUNTS).mapInArrow(_judge(line_odds(counts, common)[0], *document_mixture(a, common)), f"{schema}, prose_odds double")
    else:
        judged = a.select("doc_id", *[F.lit(0).cast("long").alias(f"{c}_chars") for c in CLASSES], F.lit(None).cast("double").alias("prose_odds"))
    others = [F.col(f"{c}_chars") for c in CLASSES[1:]]
    other = others[0] + others[1] + others[2]
    top = F.greatest(*others)
    kind = (
        F.when(other + F.col("prose_chars") == 0, F.lit(None))
        .when(other <= F.col("prose_chars"), "prose")
        .when(others[0] == top, "list")
        .when(others[1] == top, "table")
        .otherwise("junk")
    )
    blank = other + F.col("prose_chars") == 0
    return judged.withColumn("kind", kind).withColumn("prose_odds", F.when(~blank, F.col("prose_odds")))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(*_inputs(spark, sf_dir)).where("kind <> 'prose'").select("doc_id")


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(*_inputs(spark, sf_dir))


def p8_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(*_inputs(spark, sf_dir))


_LM, _BLANKS = r"\p{L}\p{M}\p{N}", r"\p{Z}\p{C}"
_FOLD = "strip_accents(lower({}))"
SQL = {
    "p8_stats": f"""
        with w as (select doc_id, unnest(regexp_extract_all(text, '[{_LM}]+')) as word from documents),
        c as (select distinct {_FOLD.format('word')} as word from common_words),
        n as (select doc_id, count(*) as n_words, sum(length(w.word)) as n_letters, count(c.word) as n_common
              from w left join c on {_FOLD.format('w.word')} = c.word group by doc_id),
        l as (select doc_id, unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) as line from documents),
        m as (select doc_id, count(*) as n_lines, count(*) filter (regexp_matches(line, '[.!?…"”»’)\\]][{_BLANKS}]*$')) as n_ended, sum(length(line)) as n_chars,
                     sum(length(regexp_replace(line, '[{_LM}{_BLANKS}.,;:!?''"()\\-–—’‘“”„«»…]', '', 'g'))) as n_symbols
              from l where regexp_matches(line, '[^{_BLANKS}]') group by doc_id)
        select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_lines, 0)::bigint as n_lines,
               n_letters::double / n_words as mean_word_length, n_symbols::double / m.n_chars as symbol_share,
               n_ended::double / n_lines as ended_share, n_common::double / n_words as common_share
        from documents d left join n on d.doc_id = n.doc_id left join m on d.doc_id = m.doc_id""",
}
