"""Fixed values that must equal the original tool's for equal results.

Everything here is data, stated plainly and in its natural order.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (transcript parsing, batching, extraction loop)
# ---------------------------------------------------------------------------
DEFAULT_INITIAL_SPEAKER = "MATT"
SPEAKER_PATTERN = "^[A-Z]+:"
DEFAULT_MAX_TEXT_LENGTH = 5000
REQUEST_INTERVAL_S = 1.5
MAX_RETRIES = 10
ALIGN_TOLERANCE_S = 60.0
SCENE_FIELDS = [
    "character",
    "speaker",
    "in_game",
    "background",
    "action",
    "object",
    "poses",
    "start_time",
    "end_time",
    "scene_description",
]

# ---------------------------------------------------------------------------
# FIXED VALUES (playback viewer)
# ---------------------------------------------------------------------------
SCENE_DURATION_S = 5
NUM_IMAGE_VARIATIONS = 12
# episode -> (game start, break start, break end), seconds
EPISODE_META = [
    ("c2e001", 854, 5529, 6547),
    ("c2e002", 504, 7583, 8470),
    ("c2e003", 420, 7992, 8921),
]
DEFAULT_IMAGE_BASE_URL = "https://example.invalid/scenes"
ENVIRONMENT = "environment"

# ---------------------------------------------------------------------------
# FIXED VALUES (prompt enrichment)
# ---------------------------------------------------------------------------
VETH_EPISODE = 97
MOLLYMAUK_EPISODE = 26
PLAYER_CHARACTERS = ["beau", "jester", "fjord", "caleb", "yasha", "mollymauk", "nott", "veth", "caduceus"]
CHARACTER_DESC_PREFIX = "a picture of"
CHARACTER_TOKENS = {
    "fjord": "[critrole-fjord]",
    "beau": "[critrole-beau]",
    "jester": "[critrole-jester]",
    "caleb": "[critrole-caleb]",
    "caduceus": "[critrole-caduceus]",
    "nott": "[critrole-nott]",
    "veth": "[critrole-veth]",
    "yasha": "[critrole-yasha]",
    "mollymauk": "[critrole-mollymauk]",
    "essek": "[critrole-essek]",
}
ADDITIONAL_PROMPTS = {
    "fjord": "a male half-orc warlock. black hair. green skin.",
    "beau": "a female human monk. human ears. light brown skin. wearing blue clothes.",
    "jester": "female tiefling cleric, blue skin, blue hair.",
    "caleb": "male human wizard. human ears. light skin. wearing a brown coat.",
    "caduceus": "a male firbolg cleric.",
    "nott": "a female goblin rogue. green skin.",
    "veth": "a female halfling rogue/wizard.",
    "yasha": "a female aasimar barbarian. human ears. black hair. wearing full black leather armor.",
    "mollymauk": "a male tiefling blood hunter. purple skin.",
    "essek": "a male drow wizard.",
}
ADDITIONAL_NEGATIVE_PROMPTS = {
    "fjord": "",
    "beau": "pointy ears. elf ears. elven ears. elf. elven.",
    "jester": "",
    "caleb": "pointy ears. elf ears. elven ears. earrings. elf. elven.",
    "caduceus": "",
    "nott": "",
    "veth": "",
    "yasha": "pointy ears. elf ears. elven ears. wings.",
    "mollymauk": "",
}
PROMPT_AUGMENTATION = (
    "D&D fantasy art style. high quality. sharp focus. artstation. professional. "
    "anatomically correct. realistic. proportional features. realistic hand placement. "
    "accurate finger count. symmetrical facial features."
)
DEFAULT_NEGATIVE_PROMPT = (
    "nsfw, nude, nudity, explicit, sexual, blank background, plain background, "
    "letters, words, copy, watermark, "
    "ugly, distorted, deformed, copied characters, duplicate characters, "
    "repeated patterns, uncanny valley, "
    "distorted facial features, distorted hands, extra limbs, distorted fingers, "
    "(concept art)1.5, "
    "worst quality, low quality, normal quality, low resolution, "
    "worst resolution, normal resolution, collage, bad anatomy of fingers, "
    "error hands, error fingers"
)
DM_CHARACTER = "dm-matt-mercer"
DM_TOKEN = "[dm-matt-mercer]"
DM_PROMPT_PREFIX = "[dm-matt-mercer] wearing a hooded cloak. "
NON_PC_PROMPT_PREFIX = "In a D&D fantasy world, "
# character -> expected speaker (consistency check only)
SPEAKER_MAP = {
    "fjord": "TRAVIS",
    "beau": "MARISHA",
    "jester": "LAURA",
    "caduceus": "TALIESIN",
    "mollymauk": "TALIESIN",
    "yasha": "ASHLEY",
    "caleb": "LIAM",
    "veth": "SAM",
    "nott": "SAM",
    "matt": "MATT",
    "environment": "MATT",
    "npc": "MATT",
}

# ---------------------------------------------------------------------------
# FIXED VALUES (image generation and training preparation)
# ---------------------------------------------------------------------------
IMAGES_PER_PROMPT = 8
BATCHES_PER_PROMPT = 1
TRANSCRIPT_LANGUAGES = ["en-US", "en"]
