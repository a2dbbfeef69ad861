"""Fixed values the results depend on: vocabularies, aliases, patterns.

Every list is a parameter of the jobs that use it; these are the defaults. Patterns are Java
regular expressions; ``(?U)`` marks those whose classes must be Unicode aware.
"""

from __future__ import annotations

# --- fixed values: vocabularies ---------------------------------------------------------------
WORK_STATUSES = ("matched", "review", "not_found", "pending", "error")
RECOGNITION_STATUSES = ("matched", "review", "not_found", "unrecognized", "error")
RESOURCE_GROUPS = ("media", "person", "series", "music", "nsfw", "other", "unrecognized")
RESOURCE_CLASSES = ("media", "collection", "music", "person", "nsfw", "other")
AVAILABILITY = ("available", "pending", "invalid", "unknown")
MEDIA_TYPES = ("movie", "tv", "unknown")
KINDS = ("media", "person", "series")
MESSAGE_STATUSES = ("imported", "duplicate", "ignored", "failed", "pending_validation", "queued")
LINK_STATUSES = ("inserted", "duplicate", "invalid", "pending_validation", "error")
SOURCE_TYPES = ("115", "123", "guangya", "ed2k")
PLACEHOLDER_TITLE = "未命名"

# --- fixed values: label line -----------------------------------------------------------------
WHOLE_SEASON = " 整季"
LABEL_SEPARATOR = "、"
LABEL_TOTAL = " 等 %d 个"
NO_LABEL = "未提取"

# --- fixed values: facet aliases --------------------------------------------------------------
QUALITY_GROUPS = {
    "2160P": ("2160P", "4K", "UHD"),
    "1080P": ("1080P",),
    "1080I": ("1080I",),
    "720P": ("720P",),
    "480P": ("480P",),
}
CODEC_GROUPS = {
    "h265": ("H.265", "H265", "X265", "HEVC"),
    "h264": ("H.264", "H264", "X264", "AVC"),
    "av1": ("AV1",),
}
CATEGORY_GENRES = {"anime": (16,), "documentary": (99,), "variety": (10764, 10767)}
NOT_DRAMA_GENRES = (16, 99, 10764, 10767)
EARLIER_THAN = 2007
WESTERN_COUNTRIES = (
    "US", "GB", "FR", "DE", "IT", "ES", "CA", "AU", "NZ", "IE", "NL", "SE", "NO", "DK", "FI", "BE", "AT", "CH", "PL",
    "CZ", "HU", "GR", "PT", "RU", "RO", "UA", "IS", "MX", "BR", "AR", "CL", "CO",
)
WESTERN_NAMES = ("europeandamerica", "western", "欧美", "eu_us")

# --- fixed values: providers ------------------------------------------------------------------
# (id, label, whether a link can be checked)
PROVIDERS = (
    ("115", "115 网盘", True),
    ("123", "123 网盘", True),
    ("guangya", "光鸭云盘", True),
    ("aliyun", "阿里云盘", False),
    ("quark", "夸克网盘", False),
    ("tianyi", "天翼云盘", False),
    ("pikpak", "PikPak", False),
    ("ed2k", "ED2K", False),
)
UNKNOWN_PROVIDER = "未知来源"
# (pattern, provider, link kind); the host decides the provider of a share link.
SHARE_LINK = r"(?i)https?://(?:www\.)?(?:115(?:cdn)?|123865|123pan|guangyapan)\.com/s/[^\s<>]+"
HASH_LINK = r"(?i)ed2k://\|file\|[^|]+\|\d+\|[A-Fa-f0-9]{32}\|/"
HOST_PROVIDERS = {
    "115.com": "115", "115cdn.com": "115", "123865.com": "123", "123pan.com": "123", "guangyapan.com": "guangya",
}
ACCESS_KEYS = ("password", "pwd", "code", "receive_code", "access_code")
SECRET_KEYS = ACCESS_KEYS + ("token", "access_token")

# --- fixed values: file names -----------------------------------------------------------------
AUDIO_EXTENSIONS = (
    "mp3", "flac", "wav", "ape", "aac", "m4a", "dsf", "dff", "wv", "alac", "ogg", "opus", "aiff", "aif", "dts",
    "tta", "wma", "mka", "mid", "midi",
)
VIDEO_EXTENSIONS = (
    "mkv", "mp4", "ts", "m2ts", "avi", "mov", "rmvb", "wmv", "m4v", "mpg", "mpeg", "vob", "iso", "flv", "webm",
    "mk3d", "rm", "3gp",
)
IMAGE_EXTENSIONS = (
    "jpg", "jpeg", "png", "webp", "gif", "bmp", "tif", "tiff", "avif", "heic",
)
PRIMARY_VIDEO = (
    "mkv", "mp4", "m4v", "mov", "avi", "wmv", "webm", "ts", "m2ts", "iso", "rm", "rmvb",
)
PRIMARY_AUDIO = (
    "mp3", "flac", "m4a", "ape", "wav", "aac", "ogg", "opus", "wma", "dsf", "dff", "alac", "aiff",
)
ARTWORK_STEM = (
    r"(?i)^(?:(?:season|s)\d{1,2}[-_.])?(?:poster|fanart|folder|backdrop|banner|clearlogo|clearart|"
    r"discart|disc|landscape|thumb|logo|cover|show|movie|tvshow)(?:[-_.]?\d+)?$"
)
EPISODE_THUMB = r"(?i)^s\d{1,2}e\d{1,3}[-_.]thumb$"
IMAGE_CONTENT_TITLE = r"(?i)写真|套图|漫画|画集|画册|壁纸|CG|扫描|摄影|图集|素材|图片|相册|原画|插画"

# --- fixed values: class words ----------------------------------------------------------------
STABLE_CODE = (
    r"(?i)^\s*(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\s*)?(?:\[[^\]]*\]\s*)?([A-Z]{2,6}-\d{3,5})(?![A-Z0-9])"
)
MUSIC_TITLE = r"(?i)音乐|专辑|歌曲|演唱会|音乐会|交响|无损|原声大碟|单曲|(?<![A-Za-z])OST(?![A-Za-z])"
MUSIC_FORMAT = r"(?i)(?<![a-z0-9])(?:flac|ape|wav|dsd|dsf|mp3|m4a|hi-?res|alac)(?![a-z0-9])"
PACK_WORDS = r"(?i)资源包|电影集"

# --- fixed values: message layout -------------------------------------------------------------
ICONS = "📺🎥🎬👤🗂🍿🎞️"
KIND_ICONS = {"👤": "person", "🗂": "series", "📺": "media", "🎥": "media", "🎬": "media"}
ICON_PREFIX = r"^\s*[📺🎥🎬👤🗂🍿🎞️]+\s*"
HEADING_ICON = r"^\s*([📺🎥🎬👤🗂])"
LINE_ICON = r"^[📺🎥👤🗂]\s*"
CATEGORY_LINE = r"^(?:🗂\s*)?(?:分类|收录版本|播出进度)\s*[：:]"
METADATA_PREFIXES = ("🌟", "📽", "🌍", "🗣", "👥", "📖", "💾", "🙋")
CHANNEL_ATTRIBUTE = (
    r"^(?:👤|🗂|🏷|📺|🎭|🖥|📼|📦|⭐|🌟|📖|🔎)\s*"
    r"(?:分享|投稿人|分类|收录版本|播出进度|标签|质量|画质|集数|大小|类型|简介|TMDB(?:评分)?)\s*[：:]"
)
LABEL_PREFIX = r"^\s*(?:资源)?(?:名称|片名|剧名|标题|资源名)\s*[：:]\s*"
CATEGORY_PREFIX = r"^(?:剧集|电影|动漫|综艺)\s*[：:]\s*"
SYNOPSIS_LINE = r"^\s*(?:剧情简介|内容简介|剧情介绍|简介)\s*[：:]"
GENERIC_LABELS = ("链接", "点击跳转", "链接点击跳转")
GENERIC_PREFIXES = ("🔗", "📎")
GENERIC_PHRASE = "点击保存到"
EDGE = r" \t\-–—|·"
BRACKETS = r"()（）\[\]【】"
NAME_EDGE = r" \t\-–—|·()（）\[\]【】✨，,。、；;：:…！？!?"
ACCESS_CODE = r"(?i)(?:访问码|提取码|访问密码|密码|password|pwd)\s*[：:=\s]+([A-Za-z0-9]{2,16})"
LABELS = {
    "评分": "rating", "类型": "genres", "地区": "countries", "语言": "languages", "主演": "cast",
    "导演": "directors", "简介": "overview", "投稿": "submitter", "投稿人": "submitter", "搜索": "search",
    "机场": "airports", "包含影片": "included_films", "代表作": "representative_works", "生日": "birthday",
    "出生地": "birthplace",
}

# --- fixed values: years, seasons, episodes ---------------------------------------------------
YEAR = r"(?<!\d)((?:19|20)\d{2})(?![\dpP])"
FIRST_YEAR = r"^(?s:(?!(?<!\d)(?:19|20)\d{2}(?![\dpP])).)*(?<!\d)((?:19|20)\d{2})(?![\dpP])"
BRACKETED_YEAR = r"[(\[（【]\s*((?:19|20)\d{2})\s*[)\]）】]"
TRAILING_DATE = r"[(\[（【]\s*(?:19|20)\d{2}\s*[-/.]\s*\d{1,2}\s*[-/.]\s*\d{1,2}\s*[)\]）】]\s*$"
EPISODE = r"(?iU)\bS(\d{1,2})\s*E(\d{1,3})\b"
EPISODE_RANGE = r"(?iU)\bE(\d{1,3})\s*[-~]\s*E(\d{1,4})\b"
EPISODE_SPAN_CN = r"第?\s*(\d{1,4})\s*[-~至到]\s*(\d{1,4})\s*集"
EPISODE_TOTAL = r"全\s*(\d{1,4})\s*集"
SEASON_CN = r"第\s*([一二三四五六七八九十]{1,3})\s*季"
SEASON_RANGE = r"(?iU)\bS(\d{1,2})\s*[-~]\s*S?(\d{1,2})(?=$|\D)"
SEASON = r"(?iU)\bS(\d{1,2})\b"
SEASON_TOTAL = r"[全共]\s*(\d{1,2})\s*季"
SEASON_SPAN = r"第?\s*(\d{1,2})\s*[-~至到]\s*(\d{1,2})\s*季"
SEASON_SINGLE = r"第\s*(\d{1,2})\s*季"
EPISODE_PROGRESS = r"(?:更新|更)\s*[至到]?\s*第?\s*(\d{1,4})\s*(?:集|话|期)?"
PROGRESS_OWNER = r"第\s*(\d{1,2}|[一二三四五六七八九十]{1,3})\s*季\s*更新"
EPISODE_SINGLE = r"第\s*(\d{1,4})\s*集"
BARE_SPAN = r"\s*[\[(（【]?\s*(\d{1,4})\s*[-~至到]\s*(\d{1,4})\s*(?=[\])）】]|$|\s|[-–—|·])"
EPISODE_HINT = r"(?iU)[SE]\d|[季集话期更]|\d\s*[-~至到]"
BARE_HINT = r"(?U)\d\s*[-~至到]\s*\d"
FILE_EPISODE = r"(?i)(?:^|[._\-\s\[\]()/【】])S(\d{1,2})[._\-\s]*E(\d{1,3})(?=$|[._\-\s\[\]()/【】])"
FILE_SEASON = r"(?i)(?:^|[._\-\s\[\]()/【】])S(\d{1,2})(?=$|[._\-\s\[\]()/【】])"
FILE_SPAN = (
    r"(?i)(?:^|[._\-\s\[\]()【】])S(\d{1,2})[._\-\s]*E(\d{1,3})"
    r"(?:\s*[-~]\s*(?:S(\d{1,2})[._\s]*)?E?(\d{1,3}))?(?=$|[._\-\s\[\]()【】])"
)
TV_TEXT = (
    r"(?i)(?:S\d{1,2}(?:\s*E\d{1,3})?|EP\s*\d{1,4}|(?:更新|更)\s*[至到]?\s*第?\s*\d{1,4}\s*(?:集|话|期)?|"
    r"第\s*\d{1,4}\s*[集话期]|第\s*[一二三四五六七八九十百]+\s*[集话期]|全\s*\d*\s*集|全集|全\s*\d+\s*季|"
    r"共\s*\d+\s*季|第\s*[0-9一二三四五六七八九十百]+\s*季|\d{1,3}\s*[-~至到]\s*\d{1,3}\s*集|"
    r"剧集|电视剧|连续剧|综艺|动漫|番剧)"
)
MOVIE_TEXT = r"电影|剧场版"
EPISODE_SUFFIX_RANGE = (19, 999)

# --- fixed values: technical words ------------------------------------------------------------
QUALITY = r"(?i)(2160p|1080p|1080i|720p|576p|480p|4K)"
CODEC = r"(?i)(H[._-]?26[45]|x26[45]|HEVC|AV1|AVC)"
TECHNICAL = (
    r"(?iU)(?<!\w)(?:2160p|1080p|1080i|720p|576p|480p|4k|web[._ -]?dl|webrip|bluray|bdrip|hdtv|remux|dvdrip|"
    r"ddp?|aac|dts|truehd|flac|h[._-]?26[45]|x26[45]|hevc|av1|avc|hdr|dv)(?!\w)"
)
NOISE = r"(?i)(高码率|臻彩|杜比视界|杜比|蓝光原盘|蓝光|原盘|hdr10\+?|hdr|dovi|60帧|高帧率|1080|2160|720)"
AUDIO = (
    r"(?iU)\b(DDP?|AAC|DTS(?:[-_. ]HD)?(?:[-_. ]MA)?|TrueHD|FLAC)"
    r"(?:\s*([0-9]+)(?:[.\s]+([0-9]+))?)?(?:[.\s]*(Atmos))?\b"
)
FILE_AUDIO = (
    r"(?i)(DDP?\d(?:\.\d)?(?:\.Atmos)?|AAC\d(?:\.\d)?|AAC|DTS(?:-HD)?(?:\.MA)?\d?(?:\.\d)?|"
    r"TrueHD(?:\.Atmos)?|FLAC\d?(?:\.\d)?)"
)
HDR_TAGS = (
    ("DV", r"(?iU)(?<!\w)DV(?!\w)"),
    ("HDR10+", r"(?i)HDR10P|HDR10\+"),
    ("HDR10", r"(?iU)(?<!\w)HDR10(?!\w)"),
    ("HDR", r"(?iU)(?<!\w)HDR(?!\w)"),
    ("SDR", r"(?iU)(?<!\w)SDR(?!\w)"),
)
TECHNICAL_TAGS = (
    ("8K", "(?i)(?<![A-Za-z0-9])8K(?![A-Za-z0-9])"),
    ("2160p", "(?i)(?<![A-Za-z0-9])2160[pi](?![A-Za-z0-9])"),
    ("4K", "(?i)(?<![A-Za-z0-9])4K(?![A-Za-z0-9])"),
    ("1080p", "(?i)(?<![A-Za-z0-9])1080[pi](?![A-Za-z0-9])"),
    ("720p", "(?i)(?<![A-Za-z0-9])720p(?![A-Za-z0-9])"),
    ("576p", "(?i)(?<![A-Za-z0-9])576[pi](?![A-Za-z0-9])"),
    ("480p", "(?i)(?<![A-Za-z0-9])480[pi](?![A-Za-z0-9])"),
    ("UHD", "(?i)(?<![A-Za-z0-9])(?:UHD|Ultra[ ._-]?HD)(?![A-Za-z0-9])"),
    ("超高清", "臻享超高清|超高清"),
    ("高清", "(?<!超)高清"),
    ("蓝光", "蓝光|Blu[ ._-]?ray"),
    ("原盘", "原盘|BDRemux|BDMV"),
    ("REMUX", "(?i)(?<![A-Za-z0-9])REMUX(?![A-Za-z0-9])"),
    ("WEB-DL", r"(?i)WEB[._\- ]?DL"),
    ("WEBRip", r"(?i)WEB[._\- ]?Rip"),
    ("HDTV", "(?i)(?<![A-Za-z0-9])HDTV(?![A-Za-z0-9])"),
    ("H.265", r"(?i)(?<![A-Za-z0-9])(?:H[._\- ]?265|HEVC|x265)(?![A-Za-z0-9])"),
    ("H.264", r"(?i)(?<![A-Za-z0-9])(?:H[._\- ]?264|AVC|x264)(?![A-Za-z0-9])"),
    ("AV1", "(?i)(?<![A-Za-z0-9])AV1(?![A-Za-z0-9])"),
    ("Dolby Vision", r"(?i)Dolby[._\- ]?Vision|(?<![A-Za-z0-9])(?:DoVi|DV)(?![A-Za-z0-9])"),
    ("HDR10+", r"(?i)HDR10\+|HDR10P"),
    ("HDR10", r"(?i)(?<![A-Za-z0-9])HDR10(?!\+|P|[A-Za-z0-9])"),
    ("HDR", "(?i)(?<![A-Za-z0-9])HDR(?![A-Za-z0-9+])"),
    ("SDR", "(?i)(?<![A-Za-z0-9])SDR(?![A-Za-z0-9])"),
    ("DDP", r"(?i)(?<![A-Za-z0-9])DDP(?:[ ._-]?([0-9]\.[0-9]))?(?![A-Za-z0-9])"),
    ("DD", r"(?i)(?<![A-Za-z0-9])DD(?:[ ._-]?([0-9]\.[0-9]))?(?![A-Za-z0-9])"),
    ("DTS-HD MA", r"(?i)DTS[._\- ]?HD[._\- ]?MA"),
    ("DTS", "(?i)(?<![A-Za-z0-9])DTS(?![A-Za-z0-9])"),
    ("TrueHD", "(?i)(?<![A-Za-z0-9])TrueHD(?![A-Za-z0-9])"),
    ("Atmos", "(?i)(?<![A-Za-z0-9])Atmos(?![A-Za-z0-9])"),
    ("AAC", "(?i)(?<![A-Za-z0-9])AAC(?![A-Za-z0-9])"),
    ("FLAC", "(?i)(?<![A-Za-z0-9])FLAC(?![A-Za-z0-9])"),
    ("60fps", r"(?i)(?<![A-Za-z0-9])(?:60fps|60[._\- ]?FPS)(?![A-Za-z0-9])"),
    ("IMAX", "(?i)(?<![A-Za-z0-9])IMAX(?![A-Za-z0-9])"),
    ("3D", "(?i)(?<![A-Za-z0-9])3D(?![A-Za-z0-9])"),
    ("修复版", r"AI\s*修复|修复版"),
)
TAGS_WITH_CHANNELS = ("DDP", "DD")
TAG_IMPLIED_BY = {"DTS": "DTS-HD MA"}
QUALITY_FROM_TAGS = (("2160P", ("UHD", "4K")), ("1080P", ("蓝光", "原盘", "REMUX")))

# --- fixed values: release names --------------------------------------------------------------
TECHNICAL_STOP = (
    r"(?i)(?:^|[._\-\s])(2160p|1080p|1080i|720p|576p|480p|4K|WEB[._-]?DL|WEBRip|BluRay|BDRip|HDTV|REMUX|DVDRip|"
    r"NF|AMZN|DSNP|HMAX|VIU|AI修复(?:版)?|修复版)(?=$|[._\-\s])"
)
MEDIA_EXTENSION = r"(?i)\.(mkv|mp4|m4v|mov|avi|wmv|webm|ts|m2ts|iso|rmvb?)(?:\s.*)?$"
COPIED_TEXT = r"(?i)\s*(?:访问码|提取码|密码)\s*[：:].*$|\s*复制这段内容.*$"
SITE_PREFIX = (
    r"(?i)^\s*(?:https?://)?(?:[\[【(（]\s*)?(?:www\.)?(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+"
    r"(?:com|net|org|la|cc|tv|me|info|xyz|top|club|vip|cn|io|co|site|online|link)\s*(?:[\]】)）]\s*)?\s*[@＠]\s*"
)
SECONDARY_START = r"(?i)(?:^|[._\-\s])(BluRay|BDRip|DVDRip|WEB[._-]?DL|WEBRip|HDTV|REMUX)(?=$|[._\-\s])"
SECONDARY_STOP = (
    r"(?i)(?:^|[._\-\s])(?:\d{3,4}[pi]|[48]K|UHD|HQ|HD|V\d+|\d+FPS|\d+bits?|BluRay|BDRip|REMUX|IMAX|REPACK|PROPER|"
    r"WEB[._-]?DL|WEBRip|USA|JPN|GER|GBR|FRA|ITA|ESP|KOR|CHN|HKG|TW|AC3(?:\.\d+)?|AAC\d*(?:\.\d+)?|"
    r"DTS(?:-HD)?(?:\.MA)?\d*(?:\.\d+)?|DDP?\d*(?:\.\d+)?|TrueHD(?:\.Atmos)?|FLAC\d*(?:\.\d+)?|"
    r"H[._-]?26[45]|x26[45]|AVC|HEVC|AV1|VP9|LPCM|DV|HDR10\+|HDR10P?|HDR|SDR|EDR|\d+Audios?|FFans@[^._\-\s]*)"
    r"(?=$|[._\-\s])"
)
TECHNICAL_TITLE = (
    r"(?i)^(?:\d{3,4}[pi]|[48]k|uhd|hq|hd|v\d+|\d+fps|\d+bits?|bluray|bdrip|remux|imax|repack|proper|webdl|webrip|"
    r"hdtv|dvdrip|[hx]26[45]|hevc|avc|av1|hdr10p?|hdr|dv|sdr|dts|dtshd|aac|ac3|flac|truehd|atmos|lpcm|vp9|edr|"
    r"s\d{1,2}(?:e\d{1,3})?)+$"
)
BILINGUAL_SPLIT = r"(?<=[)）\]】])\s+[-–—]\s+(?=[A-Za-z])"
BRACKETED_ALIAS = r"^[\[【]([^\]】]+)[\]】][._\s]*(.+)$"
RELEASE_GROUP_WORDS = (
    r"(?i)(?:LGNB|H3LL|FRDS|WiKi|CMCT|TLF|HDChina|QHstudIo|BeiTai|ADWeb|OurTV|"
    r"封装|封裝|压制|壓制|首发|首發|独家|獨家|重制|重製)"
)
# Explicit catalogue ids: typed shorthand, official link, plain shorthand.
TYPED_ID = r"(?i)\{?\s*(movie|tv|剧集|电影)\s+tmdb(?:id)?\s*[-:=：]\s*(\d+)\s*\}?"
URL_ID = r"(?i)themoviedb\.org/(movie|tv)/(\d+)"
PLAIN_ID = r"(?i)\{?\s*tmdb(?:id)?\s*[-:=：]\s*(\d+)\s*\}?"

# --- fixed values: search-noise tails ---------------------------------------------------------
NOISE_TAILS = (
    r"(?:更新|更)\s*[至到]?\s*第?\s*\d{1,4}\s*(?:集|话|期)?\s*$",
    r"(?i)\s*(?:ep|e)\s*\d{1,4}\s*$",
    r"\s*第\s*\d{1,4}\s*[集话期]\s*$",
    r"(?i)(?:\s*(?:4k|8k|2160p|1080p|720p|2160|1080|720|高码率|臻彩|杜比视界|杜比|hdr10\+?|hdr|dovi|60帧|高帧率|"
    r"蓝光原盘|蓝光|原盘))+$",
)

# What any of these takes away at least one of.
NOISE_PIECE = r"(?i)\d|高码率|臻彩|杜比|hdr|dovi|高帧率|蓝光|原盘"

# --- fixed values: title variants -------------------------------------------------------------
EDITION_SUFFIX = (
    r"(?i)(?:\s*[（(【\[]?\s*(?:director'?s?\s+cut|directors\s+cut|theatrical(?:\s+(?:cut|version))?|"
    r"extended(?:\s+(?:edition|cut))?|unrated|remastered|international(?:\s+(?:version|cut))?|"
    r"movie|完整版|导演剪辑版|加长版|未删减版|无删减版|修复版|重制版|国际版|杜比(?:版)?)"
    r"\s*[）)】\]]?)$"
)
CJK_LATIN_BOUNDARY = r"(?<=[\u3400-\u9fff])\s+(?=[A-Za-z])"
CJK, KANA_OR_HANGUL = r"[\u3400-\u9fff]", r"[\u3040-\u30ff\u1100-\u11ff\u3130-\u318f\uac00-\ud7af]"

# --- fixed values: link outcomes --------------------------------------------------------------
TERMINAL_CODES = (4100008, 4100009, 4100010, 4100012)
TERMINAL_MESSAGE = r"(?i)密码|提取码|分享不存在|不存在|已取消|失效|过期|无效|HTTP 404"
STRONG_RISK = r"(?i)风控|频繁|验证码|访问限制|访问被阻断|captcha|too many|rate.?limit"
WEAK_RISK = r"(?i)验证"

# --- fixed values: collection markers ---------------------------------------------------------
COLLECTION_MARKERS = (
    r"[（(【\[]\s*(?:系列|合集|合辑|合輯|套装|套裝|套盒|合集包|全系列|系列电影|系列電影|系列合集|collection|box[ .-]?set)\s*[）)】\]]?",
    "全系列|系列电影|系列電影|系列合集|合集电影|合集包|等等(?:电影|影片|资源)",
    r"(?<=[\u4e00-\u9fff])\s*(?:套装|套裝|套盒|合辑|合輯)",
    r"合集(?=$|[\s)】）\]]|[（(【\[]|[A-Za-z]|\d|版|[：:、,，.。;；/|+·•\-–—]|4K|1080|2160|720|蓝光|原盘|高清|高码|已刮削|国语|粤语|中字|双语|HDR|HEVC|收藏|国|港|台|剧|含|外|完|电影)",
    r"全[一二三四五六七八九十百两\d]+部(?=$|[\s)】）\]]|[（(【\[]|[A-Za-z]|\d|版|[：:、,，.。;；/|+·•\-–—]|4K|1080|2160|720|蓝光|原盘|高清|高码|已刮削|国语|粤语|中字|双语|HDR|HEVC|收藏|国|港|台|剧|含|外|完|电影)",
    r"(?:(?:前|后)?[一二三四五六七八九十百两\d]+)?部曲(?=$|[\s)】）\]]|[（(【\[]|[A-Za-z]|\d|版|[：:、,，.。;；/|+·•\-–—]|4K|1080|2160|720|蓝光|原盘|高清|高码|已刮削|国语|粤语|中字|双语|HDR|HEVC|收藏|国|港|台|剧|含|外|完|电影)",
    r"系列(?=$|[\s)】）\]]|[（(【\[]|[A-Za-z]|\d|版|[：:、,，.。;；/|+·•\-–—]|4K|1080|2160|720|蓝光|原盘|高清|高码|已刮削|国语|粤语|中字|双语|HDR|HEVC|收藏|国|港|台|剧|含|外|完|电影)",
    r"[一二三四五六七八九十百两\d]+\s*[-~—至]\s*[一二三四五六七八九十百两\d]+部(?=$|[\s)】）\]]|[（(【\[]|[A-Za-z]|\d|版|[：:、,，.。;；/|+·•\-–—]|4K|1080|2160|720|蓝光|原盘|高清|高码|已刮削|国语|粤语|中字|双语|HDR|HEVC|收藏|国|港|台|剧|含|外|完|电影)",
    r"(?<=\d{4})[二三四五六七八九十两]部(?=$|[\s)】）\]]|[（(【\[]|[A-Za-z]|\d|版|[：:、,，.。;；/|+·•\-–—]|4K|1080|2160|720|蓝光|原盘|高清|高码|已刮削|国语|粤语|中字|双语|HDR|HEVC|收藏|国|港|台|剧|含|外|完|电影)",
    r"(?<!\d)(?<!第)(?<!天龙)(?<![一二三四五六七八九十百两])(?:[二三四五六七八九十百两]|\d{1,3})部(?=$|[\s)】）\]]|[（(【\[]|[A-Za-z]|\d|版|[：:、,，.。;；/|+·•\-–—]|4K|1080|2160|720|蓝光|原盘|高清|高码|已刮削|国语|粤语|中字|双语|HDR|HEVC|收藏|国|港|台|剧|含|外|完|电影)",
    r"\b(?:box[ .-]?set)\b",
)
COLLECTION = "(?i)(?:" + "|".join(COLLECTION_MARKERS) + ")"
# What every collection marker holds one of.
COLLECTION_HINT = "(?i)[系合套全等部]|collection|box"
STRIP_COLLECTION = (
    r"\s*[（(【\[]\s*(?:系列|合集|合辑|合輯|套装|套裝|套盒|合集包|全系列|系列电影|系列電影|系列合集|全集)\s*[）)】\]]?\s*$"
)

# --- fixed values: pages that messages link to ------------------------------------------------
PAGE_HOSTS = ("telegra.ph", "files.catbox.moe")
ICON_PAGE_HOSTS = ("telegra.ph",)
PAGE_LINK = r"(?i)https?://[^\s<>]+"
PAGE_LINK_END = r"[，。；;）)]+$"
PAGE_TITLE_END = r"(?i)\s*[–—-]\s*Telegraph\s*$"
PAGE_HEADING = r"(?m)^\s*([📺🎥🎬👤🗂].+)$"
HASH_START = r"(?i)^ed2k://"

# --- fixed values: seasons and episodes in file names -----------------------------------------
SEASON_EPISODE = r"(?i)(?:^|[ .\-_ /\[(])s(\d{1,4})[ .\-_]*[eEpP](\d{1,4})(?:$|[ .\-_/()\[\]])"
SEASON_X_EPISODE = r"(?i)(?:^|[ ._ /\[(])(\d{1,2})x(\d{1,4})(?:$|[ ._/)\]])"
BARE_SEASON = r"(?i)^S(\d{1,4})$"
SEASON_WORD = r"(?i)(?:^|[ .\-_ /\[(])season[ .\-_]*(\d{1,4})(?:$|[ .\-_/)\]])"
SEASON_ZH = r"第\s*([一二三四五六七八九十百零\d]+)\s*季"
EPISODE_WORD = r"(?i)(?:^|[ .\-_ /\[(])(?:ep|episode)[ .\-_]*(\d{1,4})(?:$|[ .\-_/)\]])"
EPISODE_E = r"(?i)(?:^|[ .\-_ /\[(])e(\d{1,4})(?:$|[ .\-_/)\]])"
EPISODE_ZH = r"第\s*([一二三四五六七八九十百零\d]+)\s*[集话話回]"
DATE_EPISODES = (
    r"(?<!\d)(20\d{2})[.\-_ ](0[1-9]|1[0-2])[.\-_ ]([0-3]\d)(?!\d)",
    r"(?<!\d)(20\d{2})(0[1-9]|1[0-2])([0-3]\d)(?!\d)",
)
SPECIAL_WORD = r"(?i)(?:^|[ .\-_ /\[(])(?:specials?|sp|ova|oad|oads|extra(?:s)?|ncop|nced)(?:$|[ .\-_/)\]])"
SPECIAL_ZH = r"(?i)(?:特别篇|特別篇|番外(?:篇)?|外传|外傳|总集篇|總集篇|OVA|OAD)"
SPECIAL_CODE = r"(?i)(?:^|[ .\-_ /\[(])(?:sp|ova|oad)(\d{1,4})(?:$|[ .\-_/)\]])"
FIRST_SEASON_FLAG = r"(?i)ep|episode|第|话|話|回"

# --- fixed values: what messages state of a work ----------------------------------------------
STATED_TITLE = r"(?:名称|片名|标题)\s*[:：]\s*([^\n]+)"
STATED_YEAR = r"(?:发行时间|上映时间|首播|年份)\s*[:：]\s*((?:19|20)\d{2})"
ANY_YEAR = r"(?<!\d)((?:19|20)\d{2})(?!\d)"
STATED_ICON = r"^(?:🎬|📺|🎥|🗂)\s*"
GENERIC_TITLES = (
    "美剧", "电影", "电视剧", "资源", "合集", "无海报", "未命名", "jack分享", "1080p", "1080ps01全", "标签", "链接",
)
GENERIC_TITLE_STARTS = ("1080p", "jack")
UNSAFE_TITLE_ENDS = ("总集版", "合集", "剧场版", "特别篇", "番外", "完结篇", "最终章")
STATED_SEASON = (r"第([一二三四五六七八九十\d]+)季", r"(?i)S(\d{1,2})", r"(?i)Season\s*(\d+)")
STATED_NOISE = (
    r"[（(](?:19|20)\d{2}(?:[-/.]\d{1,2}[-/.]\d{1,2})?[）)]",
    r"[（(](?:[A-Za-z][^）)]*|B站版|国配[^）)]*|粤语[^）)]*)[）)]",
    r"(?i)(?:4k|1080p|720p|hdr|dv|sdr|remux|bluray|web-?dl).*$",
    r"(?i)(?:臻彩|杜比视界|国配|粤语|双声道|高码|原盘|特效字幕|已刮削.*|更新至.*|更至.*|全\d+集|S\d+.*|第[一二三四五六七八九十\d]+季).*$",
)
STATED_TYPES = (("movie", r"#电影|类型\s*[:：]\s*电影"), ("tv", r"#电视剧|#剧集|类型\s*[:：]\s*电视剧"))
LATIN_TITLE = r"^[A-Za-z0-9 :\-]+$"

# --- fixed values: what may change a stored type ----------------------------------------------
STRONG_TV_TEXT = (
    r"(?i)(?:S\d{1,2}\s*E\d{1,3}|EP\s*\d{1,4}|(?:更新|更)\s*[至到]?\s*第?\s*\d{1,4}\s*(?:集|话|期)?|第\s*\d{1,4}\s*[集话期]|"
    r"第\s*[一二三四五六七八九十百]+\s*[集话期]|全\s*\d*\s*集|全集|全\s*\d+\s*季|共\s*\d+\s*季|第\s*[0-9一二三四五六七八九十百]+\s*季|剧集|电视剧|连续剧|综艺|动漫|番剧)"
)
#: What every strong text has a character of, or two.
STRONG_TV_SIGN = r"[更第全共剧电连综动番]|[Ss]\d|[Ee][Pp]"
TYPE_ICON = r"^\s*[📺🎥🎬]"
AUDIO_FILE_END = r"(?i)\.(?:flac|mp3|m4a|ape|wav|dsf|dff|aac|ogg|lrc)$"
AUDIO_DRAMA = "有声剧|广播剧"
UNSAFE_TYPE_TITLE = "合集|系列|有声剧|广播剧|豆瓣|AV|成人|写真|ASMR|直播|舞女|付费合集"
