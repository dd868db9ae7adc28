"""Context-mixing range coder for blocks of token ids.

A block starts from nothing and ends in its own words, so it decodes alone.
Its ids are numbered within its alphabet.  Three models predict the next id:
order 0 by the block's own frequencies, orders 1 and 2 by the id that last
followed the previous one or two, with a confidence that grows with each hit.
The prediction is their mixture; after every id each model's weight is
multiplied by the probability that it gave to what came (Bayes), within
bounds, so that no weight dies.  The two predicted ids are coded by their mixed
probability, every other within what is left by order 0.

Order 0 knows an id's frequency by its level, two levels to a doubling: the
levels go before the code words, ids are numbered level by level, and an id is
coded as its level and its place there, where all places are alike.  So no
step searches or updates a table of running sums.

Blocks have nothing in common, so many go through in step, one lane of the
arrays each: the model's arithmetic is a few array operations per position.
It uses sums, products, quotients and whole numbers alone, which every machine
rounds alike, so any worker decodes what another has encoded.
"""

from __future__ import annotations

import zlib

import numpy as np

# Contexts of two ids per lane, parts of a prediction, parts of order 0.
PAIR_SLOTS = 4096
PARTS = 65000
LEVEL_BITS = 12
# Probability of a repeated follower after so many hits in a row (state 0: no
# follower yet), and what the state becomes, by a miss and by a hit; a miss
# from up to state WEAK replaces the follower.
TRUST = np.array([0.0] + [(k + 0.3) / (k + 1.6) for k in range(15)], np.float32)
WEAK = 3
STEP = np.array([(s >> 1) - s for s in range(16)] + [min(s + 1, 15) - s for s in range(16)], np.int32)
# Bounds of a model's weight against that of order 0.
LEAST_WEIGHT, MOST_WEIGHT = np.float32(0.004), np.float32(500)
# Least number of occurrences of each level, and the number it stands for.
LEVELS = 48
FLOORS = np.unique(np.concatenate([[1, 2, 3], *[[1 << k, (3 << k) // 2] for k in range(2, 25)]]))[:LEVELS]
STANDS = np.append((FLOORS[:-1] + FLOORS[1:] - 1) // 2, FLOORS[-1])
# A longer block would leave single ids without a share of the span.
MOST_IDS = 1 << 20

_U = np.uint64
_32, _16, _PART = _U(32), _U(16), _U(LEVEL_BITS)
_LEAST = _U(1 << 32)
_TOP = _U((1 << LEVEL_BITS) - 1)
_NONE = np.int32(0x7FFF << 4)


class _Model:
    """State of all lanes: order 0 by level, and the followers of one and two
    ids (16 times the follower, plus the state)."""

    def __init__(self, sizes: np.ndarray) -> None:
        """``sizes``: how many ids of each level each lane has."""
        lanes = len(sizes)
        sizes = sizes.astype(np.int64)
        mass = sizes * STANDS
        total = np.maximum(mass.sum(axis=1), 1)[:, None]
        # every level that a lane has gets one part and its share of the others
        has = sizes > 0
        left = (1 << LEVEL_BITS) - has.sum(axis=1)[:, None]
        parts = has + mass * left // total
        parts[np.arange(lanes), mass.argmax(axis=1)] += (1 << LEVEL_BITS) - parts.sum(axis=1)
        start = np.cumsum(parts, axis=1) - parts
        self.level_of_part = np.repeat(np.tile(np.arange(LEVELS, dtype=np.uint8), lanes), parts.ravel())
        first = np.cumsum(sizes, axis=1) - sizes
        self.parts, self.start = parts.ravel().astype(_U), start.ravel().astype(_U)
        self.sizes, self.first = np.maximum(sizes, 1).ravel().astype(_U), first.ravel()
        self.room = int(sizes.sum(axis=1).max())
        # how often two ids of the block agree by chance
        self.chance = np.minimum((mass * STANDS).sum(axis=1) / (total[:, 0] * total[:, 0]), 0.5).astype(np.float32)
        # the followers of one id, then those of two
        self.after = np.full(lanes * (self.room + PAIR_SLOTS), _NONE, np.int32)
        self.weights = np.ones((2, lanes), np.float32)
        # a block begins as if after its first id: nothing here may depend on
        # the blocks that share the arrays
        self.last = np.zeros((2, lanes), np.int64)


def _run(sizes: np.ndarray, lengths: np.ndarray, symbols: np.ndarray | None,
         words: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Encode ``symbols`` (position x lane) or decode ``words`` (lane x word).
    Lanes stand by falling length.  Returns words and their counts, or symbols
    and the counts of words read."""
    decode = symbols is None
    lanes, top = len(sizes), int(lengths.max())
    model = _Model(sizes)
    span = np.full(lanes, np.iinfo(np.uint64).max, _U)
    if decode:
        out = np.zeros((top, lanes), np.int16)
        code = words[:, 0].astype(_U) << _32 | words[:, 1].astype(_U)
        used = np.full(lanes, 2, np.int64)
        flat, stride = words.ravel(), words.shape[1]
    else:
        # an id adds one word at most
        room = top + 4
        flat, stride = np.zeros(lanes * room, np.uint32), room
        low = np.zeros(lanes, _U)
        used = np.zeros(lanes, np.int64)
        level_of = np.zeros(lanes * model.room, np.uint8)
        for j, counts in enumerate(sizes):
            level_of[j * model.room:j * model.room + counts.sum()] = np.repeat(np.arange(LEVELS), counts)
    for t in range(top):
        m = int(np.count_nonzero(lengths > t)) if t >= lengths[-1] else lanes
        if not t or m != len(lane):
            lane = np.arange(m)
            base, base2, row, line = lane * model.room, lane * PAIR_SLOTS, lane << LEVEL_BITS, lane * LEVELS
            p2, p1 = model.last[:, :m]
            weights, chance = model.weights[:, :m], model.chance[:m]
            gain = np.float32(1) / chance
            at = np.empty((2, m), np.int64)
            base2 += lanes * model.room
            rng, first = span[:m], lane * stride
        # what the two contexts say, a row each
        np.add(base, p1, out=at[0])
        np.add(base2, (p1 * 40503 + p2 * 9973 >> 3) & PAIR_SLOTS - 1, out=at[1])
        entry = model.after.take(at, mode="clip")
        state, said = entry & 15, entry >> 4
        c1, c2 = said
        trust = TRUST.take(state, mode="clip")
        shares = weights * trust
        shares /= 1 + weights[0] + weights[1]
        shares += (1 - shares[0] - shares[1]) * chance
        shares *= PARTS
        parts = shares.astype(np.int64)
        parts += 1
        parts *= state > 0
        part1, part2 = parts
        # where both say the same, the second says it for both
        same = c1 == c2
        part2 += part1 * same
        part1 *= ~same
        both = part1 + part2
        unit = rng >> _16
        if decode:
            value = code[:m]
            target = (value // unit).view(np.int64)
            is2 = target < part2
            free = target >= both
            is1 = ~(is2 | free)
        else:
            x = symbols[t, :m].astype(np.int32)
            is2 = x == c2
            is1 = (x == c1) & ~is2
            free = ~(is2 | is1)
        # an id that no context predicts: its level and its place there
        start = part2 * is1
        np.copyto(start, both, where=free)
        size = np.where(is2, part2, part1)
        np.copyto(size, 65536 - both, where=free)
        offset = unit * start.view(_U)
        rng_new = unit * size.view(_U)
        share = rng_new >> _PART
        if decode:
            part = np.minimum((value - offset) // share, _TOP).view(np.int64)
            at0 = line + model.level_of_part.take(row + part, mode="clip")
        else:
            at0 = line + level_of.take(base + x, mode="clip")
        ahead = share * model.start.take(at0, mode="clip")
        count = model.sizes.take(at0, mode="clip")
        small = share * model.parts.take(at0, mode="clip") // count
        begin = model.first.take(at0, mode="clip")
        if decode:
            place = np.minimum((value - offset - ahead) // np.maximum(small, _U(1)), count - _U(1)).view(np.int64)
            x = (begin + place).astype(np.int32)
            np.copyto(x, c2, where=is2)
            np.copyto(x, c1, where=is1)
        else:
            place = x - begin
        ahead += small * place.view(_U)
        offset += ahead * free
        np.copyto(rng_new, small, where=free)
        rng[:] = rng_new
        short = np.flatnonzero(rng_new < _LEAST)
        if decode:
            value -= offset
            if len(short):
                value[short] = value[short] << _32 | flat.take(first[short] + used[short]).astype(_U)
                used[short] += 1
                rng[short] <<= _32
            out[t, :m] = x
        else:
            here = low[:m]
            here += offset
            over = np.flatnonzero(here < offset)
            if len(over):
                _carry(flat, first[over] + used[over] - 1)
            if len(short):
                flat[first[short] + used[short]] = (here[short] >> _32).astype(np.uint32)
                used[short] += 1
                here[short] <<= _32
                rng[short] <<= _32
        # each model's weight by what it gave, order 0's being 1
        hit = said == x
        weights *= 1 - trust + trust * gain * hit
        np.clip(weights, LEAST_WEIGHT, MOST_WEIGHT, out=weights)
        # a hit raises the confidence, a miss halves it or replaces the follower
        entry += STEP.take(state + (hit.view(np.int8) << 4), mode="clip")
        np.copyto(entry, x << 4 | 1, where=(state <= WEAK) & ~hit)
        model.after[at] = entry
        p2[:] = p1
        p1[:] = x
    if decode:
        return out, used
    # two last words place the code within the span that is left
    low += (span - _U(1)) >> _U(1)
    over = np.flatnonzero(low < ((span - _U(1)) >> _U(1)))
    every = np.arange(lanes) * stride
    if len(over):
        _carry(flat, every[over] + used[over] - 1)
    flat[every + used] = (low >> _32).astype(np.uint32)
    flat[every + used + 1] = (low & _U(0xFFFFFFFF)).astype(np.uint32)
    return flat.reshape(lanes, stride), used + 2


def _carry(flat: np.ndarray, at: np.ndarray) -> None:
    while len(at):
        flat[at] += np.uint32(1)
        at = at[flat[at] == 0] - 1


def alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ids of a block and every id's place among them."""
    top = int(ids.max())
    if top > 1 << 20:
        return np.unique(ids, return_inverse=True)
    here = np.zeros(top + 1, bool)
    here[ids] = True
    letters = np.flatnonzero(here)
    place = np.zeros(top + 1, np.int16)
    place[letters] = np.arange(len(letters))
    return letters, place[ids]


def _by_level(levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the alphabet in the order of its numbers, and the size of each level."""
    return np.argsort(levels, kind="stable"), np.bincount(levels, minlength=LEVELS)


def encode(blocks: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(alphabet, words) of each block of ids: the words are the bytes of the
    packed levels, these bytes, and the code.  No block may hold more than
    30,000 different ids or MOST_IDS ids."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = np.array([len(blocks[i]) for i in order])
    if lengths[0] > MOST_IDS:
        raise ValueError(f"a block of over {MOST_IDS} ids")
    symbols = np.zeros((lengths[0], len(order)), np.int16)
    sizes = np.zeros((len(order), LEVELS), np.int64)
    heads = []
    for j, i in enumerate(order):
        letters, places = alphabet(blocks[i])
        levels = (np.searchsorted(FLOORS, np.bincount(places), side="right") - 1).astype(np.uint8)
        line, sizes[j] = _by_level(levels)
        number = np.empty(len(line), np.int16)
        number[line] = np.arange(len(line))
        symbols[:len(places), j] = number[places]
        raw = zlib.compress(levels.tobytes(), 9)
        heads.append((letters, np.frombuffer(len(raw).to_bytes(4, "little") + raw + bytes(-len(raw) % 4), "<u4")))
    words, used = _run(sizes, lengths, symbols, None)
    out: list = [None] * len(blocks)
    for j, i in enumerate(order):
        out[i] = (heads[j][0], np.concatenate([heads[j][1], words[j, :used[j]]]))
    return out


def decode(blocks: list[tuple[np.ndarray, int, np.ndarray]]) -> list[np.ndarray]:
    """Ids of each (alphabet, number of ids, words)."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -blocks[i][1])
    lengths = np.array([blocks[i][1] for i in order])
    sizes = np.zeros((len(order), LEVELS), np.int64)
    words = np.zeros((len(order), max(len(blocks[i][2]) for i in order) + 1), np.uint32)
    lines = []
    for j, i in enumerate(order):
        letters, _, held = blocks[i]
        n = int(held[0])
        head = 1 + (n + 3) // 4
        levels = np.frombuffer(zlib.decompress(held[1:head].astype("<u4").tobytes()[:n]), np.uint8)
        line, sizes[j] = _by_level(levels)
        lines.append(letters[line])
        words[j, :len(held) - head] = held[head:]
    symbols, _ = _run(sizes, lengths, None, words)
    out: list = [None] * len(blocks)
    for j, i in enumerate(order):
        out[i] = lines[j][symbols[:lengths[j], j]]
    return out
