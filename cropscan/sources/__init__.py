from .bands import image_blocks, write_band_files
from .files import (
    SUBFOLDERS, image_manifest, json_field, list_images, named_files, read_csv, read_geojson, read_geojson_parts, read_metadata,
    write_collections, write_csv, write_features, write_named_files,
)
from .pixels import (
    PIXEL_SCHEMA, bucket_count, read_pixels, read_predictions, rows_to_table, save_clustered, scan_table,
    write_pixels, write_predictions,
)
from .scenes import read_scenes, replace_scenes, scenes_of

__all__ = [
    "PIXEL_SCHEMA", "SUBFOLDERS", "bucket_count", "image_blocks", "image_manifest", "json_field", "list_images", "named_files", "read_csv", "read_geojson", "read_geojson_parts", "read_metadata",
    "read_pixels", "read_predictions", "read_scenes", "replace_scenes", "rows_to_table", "save_clustered",
    "scan_table", "scenes_of",
    "write_band_files", "write_collections", "write_csv", "write_features", "write_named_files", "write_pixels", "write_predictions",
]
