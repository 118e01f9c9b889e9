from .colours import CLUSTER_PALETTE, colour_class, palette_colour, spread_palette
from .indices import BANDS, INDICES, index, register_index, with_indices
from .keys import (
    band_name, composite_key, image_key, key_part, last_date, pixel_table_key, strip_ends,
)
from .numbers import display_number, round_half_even
from .quality import (
    clear_pixels, is_bare_soil, is_clear, is_cloud, is_inside, is_opaque_black,
    with_quality_flags,
)

__all__ = [
    "BANDS", "CLUSTER_PALETTE", "INDICES", "band_name", "clear_pixels", "colour_class",
    "composite_key", "display_number", "image_key", "index", "is_bare_soil", "is_clear",
    "is_cloud", "is_inside", "is_opaque_black", "key_part", "last_date", "palette_colour",
    "pixel_table_key", "register_index", "round_half_even", "spread_palette", "strip_ends",
    "with_indices", "with_quality_flags",
]
