"""Small exact helpers on one in-memory sequence: the longest earlier copy, and its two uses."""

from array import array


def common_extension(seq: bytes | str, left: int, right: int, most: int | None = None) -> int:
    """How many symbols, up to ``most``, agree from ``left`` and from ``right`` on (``left < right``)."""
    size, step, limit = 0, 16, len(seq) - right
    if most is not None:
        limit = min(limit, most)
    while size < limit:
        step = min(step, limit - size)
        if seq[left + size : left + size + step] == seq[right + size : right + size + step]:
            size += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
            limit = min(limit, size + 2 * step)
    return size


def longest_earlier_copy(seq: bytes | str, at: int, source: int) -> tuple[int, int]:
    """Longest non-overlapping earlier copy of the text at ``at``: ``(length, source)``.

    ``source`` is the first place to try (the first occurrence of some seed found at ``at``).
    Only places that beat the best match so far are visited: the next one is the first
    occurrence of a text one symbol longer. Equal lengths therefore keep the smallest source.
    """
    best = (0, -1)
    while source >= 0:
        agree = common_extension(seq, source, at)
        length = min(agree, at - source)
        if length > best[0]:
            best = (length, source)
        if agree >= at - source or at + agree >= len(seq):
            break  # later sources leave less room
        source = seq.find(seq[at : at + agree + 1], source + 1, at)
    return best


def greedy_copies(
    seq: bytes | str, seed: int, min_length: int, allow_overlap: bool = False
) -> list[tuple[int, int, int]]:
    """Left-to-right ``(start, source, length)``; each is the best earlier copy at its start.

    With ``allow_overlap`` a bare seed may overlap its source when ``min_length == seed``.
    """
    copies: list[tuple[int, int, int]] = []
    first: dict = {}
    overlap = allow_overlap and min_length == seed
    start, last = 0, len(seq) - min_length
    while start <= last:
        source = first.setdefault(seq[start : start + min_length], start)
        gap = start - source
        if gap < min_length and not (overlap and gap > 0):
            start += 1
            continue
        length, origin = longest_earlier_copy(seq, start, source)
        if length < min_length:
            length, origin = min_length, source
        copies.append((start, origin, length))
        for place in range(start + 1, min(start + length, last + 1)):
            first.setdefault(seq[place : place + min_length], place)
        start += length
    return copies


def every_copy(
    seq: bytes | str, seed: int, min_length: int, allow_overlap: bool = False
) -> list[tuple[int, int, int]]:
    """``(start, source, length)`` of the best earlier copy at every start that has one."""
    copies: list[tuple[int, int, int]] = []
    first: dict = {}
    agreed: dict[int, int] = {}  # distance -> up to where the two texts are known to agree
    exact: set[int] = set()  # distances whose texts differ or end there
    overlap = allow_overlap and min_length == seed
    for start in range(len(seq) - min_length + 1):
        source = first.setdefault(seq[start : start + min_length], start)
        best = (0, -1)
        if overlap and source < start:
            best = (min_length, source)
        while 0 <= source < start:
            gap = start - source
            end = agreed.get(gap, 0)
            if end <= start:
                end = start
                exact.discard(gap)
            # a copy is no longer than its distance: nothing beyond that is compared
            missing = start + gap - end
            if missing > 0 and gap not in exact:
                more = common_extension(seq, end - gap, end, missing)
                end += more
                agreed[gap] = end
                if more < missing:
                    exact.add(gap)
            if min(end - start, gap) > best[0]:
                best = (min(end - start, gap), source)
            if end - start >= gap or end >= len(seq):
                break
            source = seq.find(seq[start : end + 1], source + 1, start)
        if best[0] >= min_length:
            copies.append((start, best[1], best[0]))
    return copies


#: From this length on searching for each phrase costs more than an index of all substrings.
INDEXED = 1 << 11


def lz76_phrases(seq: str, indexed: int = INDEXED) -> int:
    """Number of LZ76 phrases; an unfinished last phrase is not counted.

    A phrase is the longest text that occurs before its start, and one symbol more.
    """
    if not seq:
        return 0
    if len(seq) >= indexed:
        return _phrases_by_index(seq)
    phrases, at = 1, 0
    while at < len(seq):
        source = seq.find(seq[at], 0, at)
        length = longest_earlier_copy(seq, at, source)[0] if source >= 0 else 0
        at += length + 1
        if at >= len(seq):
            break
        phrases += 1
    return phrases


def _phrases_by_index(seq: str) -> int:
    """The same in linear time: an automaton of all substrings of what lies before the phrase.

    Each symbol is read once, to find where the phrase ends, and then added once. A state is a
    row of ``moves`` (0: none; the root is 1), ``size`` the longest text that leads to it, and
    ``link`` the state of its longest suffix that occurs elsewhere too.
    """
    symbols = {symbol: place for place, symbol in enumerate(sorted(set(seq)))}
    codes = list(map(symbols.__getitem__, seq))
    width, total = len(symbols), len(seq)
    moves = array("i", bytes(4 * width * (2 * total + 3)))
    size, link = array("i", bytes(4 * (2 * total + 3))), array("i", bytes(4 * (2 * total + 3)))
    last, states, at, phrases = 1, 2, 0, 0
    while True:
        state, end = 1, at
        while end < total and (state := moves[state * width + codes[end]]):
            end += 1
        phrases += 1
        if end + 1 >= total:
            return phrases
        for code in codes[at : end + 1]:
            new, states = states, states + 1
            size[new] = size[last] + 1
            state = last
            while state and not moves[state * width + code]:
                moves[state * width + code] = new
                state = link[state]
            if not state:
                link[new] = 1
            else:
                target = moves[state * width + code]
                if size[target] == size[state] + 1:
                    link[new] = target
                else:
                    split, states = states, states + 1
                    size[split] = size[state] + 1
                    row = target * width
                    moves[split * width : (split + 1) * width] = moves[row : row + width]
                    link[split], link[target], link[new] = link[target], split, split
                    while state and moves[state * width + code] == target:
                        moves[state * width + code] = split
                        state = link[state]
            last = new
        at = end + 1
