"""The shape of the tiles that a volume is stored in."""

from __future__ import annotations

import math
from collections.abc import Sequence

#: A cache budget in bytes, how much of it a tile may fill, and how far a tile may outgrow the patch: fixed values.
L3_BYTES, SAFETY, OVERSHOOT = 1441792, 0.8, 1.5


def tile_shape(image: Sequence[int], patch: int | Sequence[int], item_bytes: int = 4, spatial: Sequence[bool] | None = None, l3_bytes: int = L3_BYTES) -> list[int]:
    """The shape of an image's tiles for reads of patches; two or three spatial axes, and one other at most.

    A tile starts as the patch rounded up to powers of two. While it is smaller than the budget, the axis that covers
    least of its patch's length grows by one more such step, unless tiles then were more than OVERSHOOT times the
    patch on average. Lengths end at the image; an axis whose patch is 1 doesn't grow, and the other axis is kept whole."""
    spatial = list(spatial) if spatial is not None else [True] * len(image)
    if len(spatial) != len(image) or min(image, default=0) <= 0:
        raise ValueError("image needs positive sizes, and spatial one flag for each")
    axes = [a for a, s in enumerate(spatial) if s]
    if len(axes) not in (2, 3) or len(image) - len(axes) > 1:
        raise ValueError("tiles are for two or three spatial axes and one other at most")
    sizes = [int(patch)] * len(axes) if isinstance(patch, (int, float)) else [int(p) for p in patch]
    if len(sizes) != len(axes) or min(sizes) <= 0:
        raise ValueError("patch needs one positive size for each spatial axis")
    want = dict(zip(axes, sizes))
    step = {a: 1 << (p - 1).bit_length() for a, p in want.items()}
    tile = [min(image[a], step[a]) if a in want else image[a] for a in range(len(image))]
    # A plane counts as a volume of one slice, whose tile covers its patch once.
    flat = 3 - len(axes)
    while item_bytes * math.prod(tile) < l3_bytes * SAFETY:
        room = [a for a in axes if tile[a] < image[a] and want[a] != 1]
        if not room:
            break
        lag = min(room, key=lambda a: (tile[a] / want[a], a))
        grown = min(tile[lag] + step[lag], image[lag])
        if (flat + sum((grown if a == lag else tile[a]) / want[a] for a in axes)) / 3 > OVERSHOOT:
            break
        tile[lag] = grown
    return tile


def mask_tile(image_tile: Sequence[int], shape: Sequence[int]) -> list[int]:
    """The tile of a mask: the image's, no longer than the mask on any axis."""
    return [min(t, s) for t, s in zip(image_tile, shape, strict=True)]
