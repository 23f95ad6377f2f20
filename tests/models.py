"""Token models that only the tests need."""

from seqloom.operators.token_models import SymbolModel, TokenModel


class PairModel(TokenModel):
    """Two symbols to a token where they fit: token sizes only the tokenizer knows."""

    symbols = [a + b for a in "ACGT" for b in "ACGT"] + list("ACGT")

    def __init__(self, context_length):
        self.context_length = context_length

    def describe(self):
        return {"model": "pairs", "context_length": self.context_length}

    def tokenize(self, text):
        return [self.symbols.index(text[i : i + 2]) for i in range(0, len(text), 2)]

    def detokenize(self, tokens):
        return "".join(self.symbols[t] for t in tokens)

    def start(self, before):
        return None

    def step(self, state, token):
        return None

    def frequencies(self, state):
        return list(range(1, len(self.symbols) + 1))


class NextModel(SymbolModel):
    """Expects the alphabet's order, so that a context changes the code."""

    name = "next"
    order = 1

    def weights(self, recent):
        place = (self.alphabet.index(recent) + 1) % len(self.alphabet) if recent else -1
        return [8.0 if i == place else 1.0 for i in range(len(self.alphabet))]
