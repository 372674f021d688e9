"""Column types of the catalogue's tables."""

FILES = "hash string, path string, size long, mtime timestamp, kind string, taken_at timestamp, taken_src string"
GPS = "hash string, lat double, lon double"
FACES = (
    "hash string, idx long, box struct<x: float, y: float, w: float, h: float>, score float, ratio float, "
    "embedding array<float>"
)
UNREADABLE = "hash string, reason string, at timestamp, version string"
VECTORS = "hash string, embedding array<float>"
SIGNATURES = "hash string, dhash long, thumb array<float>, sharpness double, width int, height int"
REFS = "name string, ref_idx int, embedding array<float>"
EXCLUSIONS = "name string, hash string"
USERMETA = "folder string, hash string, rating int, label string, albums array<string>"
PLACES = (
    "place_id int, name string, ascii string, region string, country string, lat double, lon double"
)
OPS = "kind string, hash string, `from` string, `to` string"
SKIPPED = "path string, reason string"
JOURNAL = "id string, label string, applied_at timestamp, seq int, kind string, hash string, `from` string, `to` string"
EVENTS = "path string, kind string, event_time timestamp"
