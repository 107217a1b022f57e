"""Parameters of the engine (fixed values where results depend on them)."""

AWAY_KM, JUMP_KM, GAP_DAYS, MAX_BATCH = 3.0, 30.0, 30, 300
PRIVACY_KM, STOP_SPLIT_KM, MIN_POINTS_TO_NAME = 3.0, 3.0, 3
CENSUS_CELL, HOME_MIN_DAYS, HOME_MIN_NIGHT_DAYS, SCREEN_HITS, MATCH_KM, NEAR_MISS_SHOWN = 0.01, 5, 3, 2, 1.0, 5
NIGHT_HOURS = (19, 20, 21, 22, 23, 0, 1, 2, 3, 4, 5, 6)
TAU, NEAR_MARGIN, DEDUPE_TAU, EXEMPLARS = 0.80, 0.05, 0.85, 5
MASS, DAYS, MONTHS = 8, 4, 2
PLACE_BOUND, DROP_OFF, NO_CAMERA_SHARE = 0.60, 2, 0.80
SEE_RATE, SEE_FLOOR, SEE_CAP, CONFIDENT, SIGNAL, OUTLIER, RUNG1_SHARE = 0.10, 5, 40, 0.05, 0.01, 0.70, 0.85
ACCEPT, GRAY_LOW, AMBIGUITY, TOLERANCE_DAYS, EXEMPLAR_CAP = 0.82, 0.70, 0.03, 45, 24
IDENTITY_FLOOR, IDENTITY_MARGIN, COHERENCE = 0.45, 0.02, 0.33
MIN_BOX_SCORE, BOX_PAD, MIN_BOX_SHARE, BOX_CONTAINMENT = 0.5, 0.12, 0.02, 0.55
SAMPLE_RATE_GPS, SAMPLE_RATE_NO_GPS, SAMPLE_MIN, SAMPLE_MAX = 0.10, 0.05, 10, 40
AS_OF_HOURS = 24
PLACE_KM, LANDMARK_KM, OUTLINE_KM = 1.0, 0.3, 15.0
EARTH_KM = 6371.0
PHOTO_EXT = ("jpg", "jpeg", "heic", "heif", "png", "gif", "webp", "tif", "tiff", "dng")
VIDEO_EXT = ("mov", "mp4", "m4v", "avi", "3gp")
IMAGE_TYPES = ("JPEG", "HEIC", "HEIF", "PNG", "GIF", "WEBP", "TIFF", "DNG")
VIDEO_TYPES = ("MOV", "MP4", "M4V", "AVI", "3GP")
JUNK_NAMES = (".ds_store", "thumbs.db", "desktop.ini")
ABSENT = ("-", "", "0000:00:00 00:00:00")
#: Extension that a copy of a file type gets, and those it may keep.
EXTENSIONS = {
    "JPEG": ("JPG", ("JPG", "JPEG")),
    "HEIC": ("HEIC", ("HEIC",)),
    "HEIF": ("HEIF", ("HEIF",)),
    "PNG": ("PNG", ("PNG",)),
    "TIFF": ("TIF", ("TIF", "TIFF")),
    "WEBP": ("WEBP", ("WEBP",)),
    "GIF": ("GIF", ("GIF",)),
    "BMP": ("BMP", ("BMP",)),
    "DNG": ("DNG", ("DNG",)),
    "MOV": ("MOV", ("MOV",)),
    "MP4": ("MP4", ("MP4",)),
    "M4V": ("M4V", ("M4V",)),
    "AVI": ("AVI", ("AVI",)),
    "3GP": ("3GP", ("3GP",)),
}
#: Words that tell what a place name of a map stands for.
ADDRESS_SUFFIXES = ("巷", "弄", "號")
TRAIL_SUFFIXES = ("登山路線", "登山步道", "越嶺步道", "岩稜路線", "山腰線", "步道", "路線")
ROUTE_DESCRIPTIONS = ("拉繩", "陡上", "陡下", "艱難", "溼滑", "濕滑", "替代", "高繞", "腰繞", "捷徑", "溯溪", "溪階", "溪邊", "上稜線", "斜岩", "岩壁", "新路", "舊路", "路段")
STRUCTURE_SUFFIXES = ("橋", "隧道", "海堤", "堤防", "涼亭", "停車場", "登山口", "地下道", "陸橋", "天橋", "人行道", "月台", "出入口")
VIEW_PREFIXES = ("遠眺", "遠觀", "眺望", "可見")
LEG_JOINERS = ("往", "至", "經")
KEY_TAILS = ("路", "線", "稜", "道", "坡", "點")
#: Map tags of sights and of stays; None stands for any value.
SIGHT_TAGS = {
    "tourism": ("attraction", "museum", "gallery", "viewpoint", "zoo", "theme_park", "aquarium"),
    "leisure": ("park", "nature_reserve", "garden", "beach_resort", "marina"),
    "natural": ("beach", "peak", "bay", "cape", "volcano", "waterfall", "spring", "cave_entrance", "glacier"),
    "historic": None,
    "amenity": ("place_of_worship",),
    "waterway": ("waterfall",),
}
STAY_TAGS = {
    "tourism": ("hotel", "guest_house", "hostel", "motel", "chalet", "camp_site"),
    "amenity": ("restaurant", "cafe"),
}
COUNTRY_RANK, PEAK_KEEP_M, RANK_KM, WORD_KM = 4, 350, 0.4, 0.3
PROVENANCES = ("viewed-image:", "clip-matched:", "clip-propagated:")
LANDMARK_AT_KM, SIGHT_REACH_KM, NODE_AT_KM, LANDMARKS, BATCH_PLACES = 0.05, 0.15, 0.025, 2, 4
#: Endings of place names that say less than a district.
TOO_FINE = ("里", "鄰", "村")
SWEEP_TAU, TILES, SECOND_SHARE = 0.85, 12, 1 / 3
