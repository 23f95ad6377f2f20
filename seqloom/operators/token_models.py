"""Next-token models for the arithmetic codec, and the contract they follow.

A model is a deterministic automaton: coder and decoder walk the same states, and each state
has integer cumulative frequencies of the next token.
"""

import hashlib
import json
from abc import ABC, abstractmethod
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.formats import ALPHABET
from seqloom.functions.rangecoder import integer_cdf
from seqloom.operators import markov


#: Up to so many states a model finds them by an index of all.
INDEXED_STATES = 1 << 20


class TokenModel(ABC):
    """Instances travel to the executors; load anything heavy lazily."""

    one_token_per_symbol = False
    context_length = 0
    #: Symbols before a position that its frequencies can depend on; None for all.
    reach: int | None = None
    #: Frequencies are valid by construction.
    trusted = False

    @abstractmethod
    def describe(self) -> dict[str, Any]:
        """What an archive stores, and a decoder must match."""

    @abstractmethod
    def tokenize(self, text: str) -> list[int]: ...

    @abstractmethod
    def detokenize(self, tokens: Sequence[int]) -> str: ...

    @abstractmethod
    def start(self, before: Sequence[int]) -> Any:
        """State after the tokens ``before``."""

    @abstractmethod
    def step(self, state: Any, token: int) -> Any: ...

    @abstractmethod
    def frequencies(self, state: Any) -> Sequence[int]: ...


class SymbolModel(TokenModel):
    """One token per alphabet symbol; a state is the last ``order`` tokens as one number."""

    one_token_per_symbol = True
    trusted = True
    name = "symbol"
    order = 0

    @property
    def reach(self) -> int:
        return self.order

    def __init__(self, context_length: int = 0, scale: int = 32768, alphabet: str = ALPHABET):
        self.context_length = context_length
        self.scale = scale
        self.alphabet = alphabet
        self._ids = {symbol: number for number, symbol in enumerate(alphabet)}
        self._tables: dict[int, list[int]] = {}
        self._places: dict[int, int] = {}
        self._index: np.ndarray | None = None
        self._indexed = 0
        self._matrix = np.zeros((0, len(alphabet) + 1), np.uint64)

    def describe(self) -> dict[str, Any]:
        return {
            "model": self.name,
            "alphabet": self.alphabet,
            "context_length": self.context_length,
            "cdf_scale": self.scale,
        }

    def tokenize(self, text: str) -> list[int]:
        unknown = set(text).difference(self._ids)
        if unknown:
            raise ValueError(f"symbols outside the model alphabet: {''.join(sorted(unknown))}")
        return list(map(self._ids.__getitem__, text))

    def detokenize(self, tokens: Sequence[int]) -> str:
        return "".join(map(self.alphabet.__getitem__, tokens))

    def start(self, before: Sequence[int]) -> int:
        state = 0
        for token in before[-self.order :] if self.order else ():
            state = self.step(state, token)
        return state

    def step(self, state: int, token: int) -> int:
        # digit 0 stands for "before the text"
        base = len(self.alphabet) + 1
        return (state * base + token + 1) % base**self.order

    def recent(self, state: int) -> str:
        """The symbols a state stands for."""
        base, symbols = len(self.alphabet) + 1, []
        while state:
            state, digit = divmod(state, base)
            symbols.append(self.alphabet[digit - 1])
        return "".join(reversed(symbols))

    def weights(self, recent: str) -> list[float]:
        return [1.0] * len(self.alphabet)

    def rows(self, states: np.ndarray) -> np.ndarray:
        """Frequencies of many states, with a leading 0; those met for the first time are added."""
        places = self._rows_of(states)
        if places.min() < 0:
            for state in np.unique(states[places < 0]).tolist():
                place = self._places[state] = len(self._places)
                if place == len(self._matrix):
                    more = np.zeros((max(256, place), len(self.alphabet) + 1), np.uint64)
                    self._matrix = np.concatenate([self._matrix, more])
                self._matrix[place, 1:] = self.frequencies(state)
            places = self._rows_of(states)
        return self._matrix[places]

    def _rows_of(self, states: np.ndarray) -> np.ndarray:
        """Where the matrix has each state, -1 if nowhere: by index while that is small."""
        known = self._places
        size = (len(self.alphabet) + 1) ** self.order
        if size > INDEXED_STATES:
            return np.array([known.get(state, -1) for state in states.tolist()], np.int64)
        if self._index is None:
            self._index = np.full(size, -1, np.int32)
        if self._indexed < len(known):
            new = list(known)[self._indexed :]
            self._index[new] = np.arange(self._indexed, len(known))
            self._indexed = len(known)
        return self._index[states]

    def steps(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """:meth:`step` of many states."""
        base = len(self.alphabet) + 1
        return (states * base + tokens + 1) % base**self.order

    def frequencies(self, state: int) -> Sequence[int]:
        table = self._tables.get(state)
        if table is None:
            table = self._tables[state] = integer_cdf(self.weights(self.recent(state)), self.scale)
        return table


class UniformModel(SymbolModel):
    name = "uniform"


class MarkovModel(SymbolModel):
    """Order-n model over counts gathered by a Spark job (see :func:`train_markov`).

    The counts are stored once, as a table; an archive holds their SHA-256.
    """

    name = "markov"

    def __init__(
        self, order: int, counts: Mapping[str, Sequence[int]], pseudocount: float = 1.0, **options
    ):
        super().__init__(**options)
        if order <= 0:
            raise ValueError("a model needs an order above zero")
        if pseudocount <= 0:
            raise ValueError("a model needs a pseudocount above zero")
        self.order = order
        self.pseudocount = pseudocount
        self.counts = {context: list(map(int, row)) for context, row in sorted(counts.items())}
        listed = json.dumps(self.counts, separators=(",", ":")).encode()
        self.sha256 = hashlib.sha256(listed).hexdigest()

    def describe(self) -> dict[str, Any]:
        return {
            **super().describe(),
            "order": self.order,
            "pseudocount": self.pseudocount,
            "counts_sha256": self.sha256,
        }

    def weights(self, recent: str) -> list[float]:
        seen = self.counts.get(recent, [0] * len(self.alphabet))
        return [count + self.pseudocount for count in seen]

    def save(self, spark: SparkSession, path: str) -> None:
        rows = list(self.counts.items())
        table = spark.createDataFrame(rows, "ctx string, counts array<bigint>").coalesce(1)
        table.write.parquet(path)


def load_markov(spark: SparkSession, path: str, order: int, **options) -> MarkovModel:
    """The model saved at ``path``; options that differ change what it describes."""
    rows = spark.read.parquet(path).collect()
    return MarkovModel(order, {r["ctx"]: r["counts"] for r in rows}, **options)


#: Contexts a coder may hold in memory; a model with more is refused by its size, not its order.
MAX_CONTEXTS = 2_000_000


def train_markov(records: DataFrame, order: int = 2, **options) -> MarkovModel:
    """Fit one model over all records in one shuffle of per-task counts.

    A coder needs the whole table, so it is held by the driver and the workers; there are at
    most ``6 ** order`` contexts, whatever the number of records.
    """
    markov.check_order(order, options.get("pseudocount", 1.0))
    rows = markov.context_counts(markov.checked_alphabet(records), [], order)
    counts = {r["ctx"]: r["counts"] for r in rows.limit(MAX_CONTEXTS + 1).collect()}
    if len(counts) > MAX_CONTEXTS:
        raise ValueError(f"the model has more than {MAX_CONTEXTS} contexts; use a lower order")
    return MarkovModel(order, counts, **options)


class StretchModel(TokenModel):
    """Tokens are stretches of ``width`` symbols, cut from the left; the last may be shorter.

    The vocabulary is every text of 1 to ``width`` symbols in order of length, so a token's id
    follows from its symbols. Frequencies are those of tokens in the training records (see
    :func:`train_stretches`), one more for each that was not seen.
    """

    trusted = True

    def __init__(
        self, width: int, counts: Mapping[str, int], *, context_length: int = 0,
        scale: int = 1 << 16, alphabet: str = ALPHABET,
    ):
        if width <= 0:
            raise ValueError("a token has a symbol or more")
        self.width, self.alphabet, self.scale = width, alphabet, scale
        self.context_length = context_length
        self._digit = {symbol: number for number, symbol in enumerate(alphabet)}
        # tokens of a length come after all shorter ones
        sizes = [len(alphabet) ** n for n in range(1, width + 1)]
        self._first = [0, *(sum(sizes[:n]) for n in range(width))]
        weights = [1.0] * sum(sizes)
        for token, count in sorted(counts.items()):
            weights[self._id(token)] += count
        self._cdf = integer_cdf(weights, scale)
        self.sha256 = hashlib.sha256(",".join(map(str, self._cdf)).encode()).hexdigest()

    def _id(self, text: str) -> int:
        number = 0
        for symbol in text:
            if symbol not in self._digit:
                raise ValueError(f"symbols outside the model alphabet: {symbol}")
            number = number * len(self.alphabet) + self._digit[symbol]
        return self._first[len(text)] + number

    def describe(self) -> dict[str, Any]:
        return {
            "model": "stretches", "alphabet": self.alphabet, "width": self.width,
            "context_length": self.context_length, "cdf_scale": self.scale, "cdf_sha256": self.sha256,
        }

    def tokenize(self, text: str) -> list[int]:
        return [self._id(text[k : k + self.width]) for k in range(0, len(text), self.width)]

    def detokenize(self, tokens: Sequence[int]) -> str:
        parts = []
        for token in tokens:
            size = max(n for n in range(1, self.width + 1) if self._first[n] <= token)
            number, symbols = token - self._first[size], []
            for _ in range(size):
                number, digit = divmod(number, len(self.alphabet))
                symbols.append(self.alphabet[digit])
            parts.append("".join(reversed(symbols)))
        return "".join(parts)

    def start(self, before: Sequence[int]) -> None:
        return None

    def step(self, state: None, token: int) -> None:
        return None

    def frequencies(self, state: None) -> Sequence[int]:
        return self._cdf


def train_stretches(records: DataFrame, width: int, **options) -> StretchModel:
    """Counts of the tokens of all records: they combine in the tasks, and there are few tokens."""
    alphabet = options.get("alphabet", ALPHABET)
    places = F.expr(f"IF(length(seq) = 0, array(), sequence(1, length(seq), {width}))")
    rows = records.select(F.col("seq").cast("binary").alias("bases"), F.explode(places).alias("at"))
    tokens = rows.select(F.expr(f"CAST(substring(bases, at, {width}) AS STRING)").alias("token"))
    # at most as many rows as the vocabulary has tokens
    counts = {r["token"]: r["count"] for r in tokens.groupBy("token").count().collect()}
    return StretchModel(width, counts, **{**options, "alphabet": alphabet})
