"""Parameters of the jobs, with their defaults."""

from dataclasses import dataclass

MB = 1024 * 1024

#: File extensions by what can be done with them.
SUPPORTED = ("jpg", "jpeg", "png", "webp", "avif", "jxl", "gif", "bmp", "svg", "tiff", "tif", "heic", "heif", "dng", "cr2", "cr3", "nef", "arw", "raf", "orf", "rw2", "pef")
NO_THUMBNAIL = ("svg", "pef")
TIFF = ("tif", "tiff")
RAW = ("dng", "cr2", "cr3", "nef", "arw", "raf", "orf", "rw2")
SYSTEM = ("heic", "heif", "avif", "jxl", *RAW)
#: ISO-BMFF brands of HEIF and AVIF files.
HEIF_BRANDS = ("heic", "heix", "heim", "heis", "hevc", "hevx", "hevm", "hevs", "mif1", "msf1", "avif", "avis")
THUMB_SIZES = (96, 160, 256)
DEFAULT_THUMB = 160
ALLOWED = {"previewMaxSize": (2048, 4096, 8192), "tileSize": (256, 512, 1024), "thumbnailSize": THUMB_SIZES}


@dataclass(frozen=True)
class Policy:
    file_threshold_mb: int = 300
    pixel_threshold: int = 50_000_000
    side_threshold: int = 12_000
    bmp_candidate_mb: int = 100
    bmp_required_mb: int = 300
    thumb_max_bytes: int = 1024 * MB
    thumb_max_side: int = 12_000
    thumb_max_pixels: int = 40_000_000
    decode_max_side: int = 12_000
    decode_max_bytes: int = 512 * MB
    decode_reduced_side: int = 11_000
    raster_max_pixels: int = 100_000_000
    raster_max_bytes: int = 2 * 1024 * MB
    bmp_max_side: int = 200_000
    tile_size: int = 512
    preview_max: int = 4096
    preview_cap: int = 2048
    navigator_cap: int = 384
    prefetch_radius: int = 1
    sweep_bytes: int = 64 * MB
    tile_cache: int = 256
    pyramid_version: int = 1


DEFAULT = Policy()
