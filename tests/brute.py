"""Literal restatements of the semantics, for comparison on small inputs."""


def copies(seq, k, shortest):
    """Greedy left-to-right copies; every earlier occurrence of the seed is tried."""
    found, start = [], 0
    while start <= len(seq) - k:
        best = every_source(seq, k, start)
        if best[0] >= shortest:
            found.append((start, best[1], best[0]))
            start += best[0]
        else:
            start += 1
    return found


def every_source(seq, k, start):
    best = (0, -1)
    for source in range(start):
        if seq[source : source + k] != seq[start : start + k]:
            continue
        length = k
        while length < min(len(seq) - start, start - source) and (
            seq[source + length] == seq[start + length]
        ):
            length += 1
        if length > best[0]:
            best = (length, source)
    return best


def lz76(seq):
    if not seq:
        return 0
    at, size, phrases = 0, 1, 1
    while at + size < len(seq):
        if seq[at : at + size] in seq[:at]:
            size += 1
        else:
            at, size, phrases = at + size, 1, phrases + 1
    return phrases


def coded_bits(symbols, cdfs, width):
    """Bit-at-a-time integer arithmetic coder."""
    full = 1 << width
    low, high, waiting, bits = 0, full - 1, 0, []
    for symbol, cdf in zip(symbols, cdfs):
        size = high - low + 1
        bottom = cdf[symbol - 1] if symbol else 0
        low, high = low + bottom * size // cdf[-1], low + cdf[symbol] * size // cdf[-1] - 1
        while low >> (width - 1) == high >> (width - 1):
            top = low >> (width - 1)
            bits += [top] + [1 - top] * waiting
            waiting = 0
            low, high = 2 * low % full, 2 * high % full + 1
        while low >> (width - 2) == 1 and high >> (width - 2) == 2:
            waiting += 1
            low, high = 2 * (low - full // 4), 2 * (high - full // 4) + 1
    return bits + [1]


def restore(tiles):
    """Text of ``(start, length, source, literal)`` tiles, one after the other."""
    text = ""
    for start, length, source, literal in tiles:
        assert start == len(text)
        text += literal if source is None else text[source : source + length]
    return text
