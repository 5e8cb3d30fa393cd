"""Fixed values that results depend on: word lists, sizes and thresholds of indoor scenes."""

from __future__ import annotations

# Synonyms of object names, by single words.
SYNONYMS = {
    "sofa": ["couch"], "couch": ["sofa"],
    "tv": ["television", "monitor", "screen"], "television": ["tv", "screen"],
    "fridge": ["refrigerator"], "refrigerator": ["fridge"],
    "desk": ["table"], "stool": ["chair"],
    "trash": ["bin", "garbage", "trashcan"], "bin": ["trash", "garbage"],
    "rug": ["carpet", "mat"], "carpet": ["rug", "mat"],
    "wardrobe": ["closet", "cabinet"], "closet": ["wardrobe"],
    "backpack": ["bag"], "bag": ["backpack"],
    "telephone": ["phone"], "phone": ["telephone"],
    "light": ["lamp", "chandelier"], "lamp": ["light"],
    "picture": ["painting", "art"], "painting": ["picture"],
    "cushion": ["pillow"], "pillow": ["cushion"],
    "bathtub": ["tub"], "tub": ["bathtub"],
    "monitor": ["screen", "tv", "display"], "screen": ["monitor", "tv"],
    "laptop": ["computer", "notebook"], "computer": ["laptop", "pc"],
    "cup": ["mug", "glass"], "mug": ["cup"],
    "shelf": ["bookshelf", "shelving"], "bookshelf": ["shelf"],
    "dresser": ["drawer", "chest"], "drawer": ["dresser"],
    "whiteboard": ["board"], "board": ["whiteboard"],
    "heater": ["radiator"], "radiator": ["heater"],
    "chandelier": ["light"], "doorframe": ["door"], "mat": ["rug", "carpet"],
}

# Sizes in metres of objects that a scene's scale is set by, in the order in which they are tried.
CALIBRATION_SIZES = [
    ("door", 2.0), ("chair", 0.80), ("dining chair", 0.80), ("office chair", 1.0),
    ("bed", 2.0), ("toilet", 0.40), ("refrigerator", 1.75), ("fridge", 1.75),
    ("sofa", 0.85), ("couch", 0.85), ("table", 0.75), ("dining table", 0.75),
    ("desk", 0.75), ("window", 1.2), ("sink", 0.85), ("stove", 0.9),
    ("bathtub", 0.6), ("tv", 0.6), ("television", 0.6), ("monitor", 0.5),
    ("bookshelf", 1.8), ("cabinet", 1.0), ("nightstand", 0.6), ("lamp", 0.5),
    ("washer", 0.85), ("dryer", 0.85), ("microwave", 0.35), ("oven", 0.6),
    ("fireplace", 1.0), ("shower", 1.8), ("mirror", 0.8),
    ("washing machine", 0.85), ("piano", 1.0), ("guitar", 1.0), ("suitcase", 0.65),
    ("bucket", 0.35), ("crate", 0.5), ("coat rack", 1.7), ("column", 2.5),
]

# Usual ranges in metres, in the order in which they are tried.
COMMON_RANGES = [
    ("door", 1.5, 2.5), ("chair", 0.4, 1.2), ("bed", 1.5, 2.5),
    ("sofa", 1.2, 3.0), ("couch", 1.2, 3.0), ("table", 0.5, 2.5),
    ("desk", 0.5, 2.0), ("toilet", 0.3, 0.7), ("refrigerator", 1.2, 2.0),
    ("fridge", 1.2, 2.0), ("bathtub", 1.0, 2.0), ("window", 0.6, 2.0),
    ("sink", 0.3, 1.0), ("stove", 0.5, 1.0), ("tv", 0.3, 1.5),
    ("bookshelf", 0.8, 2.5), ("cabinet", 0.5, 2.0), ("nightstand", 0.3, 0.8),
    ("washer", 0.6, 1.0), ("dryer", 0.6, 1.0), ("microwave", 0.2, 0.5),
    ("oven", 0.4, 0.8), ("mirror", 0.3, 1.5), ("lamp", 0.2, 1.8),
    ("monitor", 0.3, 0.8), ("pillow", 0.2, 0.7), ("rug", 0.5, 4.0),
    ("curtain", 1.0, 3.0), ("shower", 0.8, 1.2),
]

# Typical sizes in centimetres where a scene has no such object, in the order in which they are tried.
TYPICAL_CM = [
    ("chair", 80), ("table", 150), ("sofa", 200), ("bed", 200), ("tv", 100), ("door", 200), ("window", 120),
    ("toilet", 60), ("sink", 50), ("lamp", 50), ("bathtub", 170), ("refrigerator", 180), ("desk", 120),
    ("stove", 65), ("oven", 65), ("microwave", 45), ("pillow", 40), ("monitor", 60), ("nightstand", 55),
    ("bookshelf", 180), ("cabinet", 150), ("shelf", 100), ("counter", 90), ("curtain", 200),
    ("painting", 60), ("picture", 50), ("mirror", 80), ("plant", 60), ("rug", 150), ("carpet", 200),
    ("cup", 10), ("clock", 30), ("fan", 40), ("trash", 50), ("bin", 50), ("towel", 60), ("shoe", 30),
    ("fireplace", 100), ("blanket", 200), ("washer", 85), ("dryer", 85), ("vase", 30), ("bottle", 25),
]

# Question types by kind.
CHOICE_TASKS = ["object_rel_direction_easy", "object_rel_direction_medium", "object_rel_direction_hard", "object_rel_distance", "obj_appearance_order", "route_planning"]
NUMERIC_TASKS = ["object_counting", "object_size_estimation", "room_size_estimation", "object_abs_distance"]

# Objects of the test tables, of the same shape as the tables above: not part of indoor scenes.
TEST_SYNONYMS = {"rod": ["bar"], "ring": ["loop"]}
TEST_SIZES = [("anvil", 0.3), ("bolt", 0.05), ("gear", 0.2), ("gizmo", 0.25), ("plate", 0.3), ("ring", 0.1), ("rod", 1.0), ("widget", 0.4)]
TEST_RANGES = [("anvil", 0.2, 0.5), ("bolt", 0.02, 0.1), ("plate", 0.2, 0.5), ("gizmo", 0.1, 0.5)]

# Red, green and blue of categories in a top-down view, in the order in which they are tried; of all others last.
COLORS = [
    ("chair", 65, 105, 225), ("table", 139, 69, 19), ("sofa", 255, 140, 0), ("couch", 255, 140, 0),
    ("bed", 148, 103, 189), ("desk", 139, 69, 19), ("door", 128, 128, 128), ("window", 135, 206, 235),
    ("tv", 220, 20, 60), ("television", 220, 20, 60), ("toilet", 255, 182, 193), ("sink", 0, 191, 255),
    ("refrigerator", 0, 128, 128), ("fridge", 0, 128, 128), ("lamp", 255, 215, 0), ("shelf", 107, 142, 35),
    ("cabinet", 85, 107, 47), ("pillow", 255, 192, 203), ("rug", 188, 143, 143), ("trash", 169, 169, 169),
    ("microwave", 100, 149, 237), ("oven", 178, 34, 34), ("plant", 34, 139, 34), ("curtain", 216, 191, 216),
    ("monitor", 220, 20, 60), ("backpack", 128, 0, 0), ("default", 150, 150, 150),
]

# Patterns of questions without a type, in the order in which they are tried; what fits none counts objects.
TASK_PATTERNS = [
    ("object_counting", ["how many", "count", "number of"]),
    ("object_abs_distance", ["distance between", "how far.*from", "meters.*between"]),
    ("object_size_estimation", ["size of", "how (big|large|tall|wide)", "dimension"]),
    ("room_size_estimation", ["room.*size", "area of.*room", "square (meter|feet)"]),
    ("object_rel_direction_easy", ["left or right", "to (my|the) (left|right)"]),
    ("object_rel_direction_medium", ["(front|back|left|right).*facing"]),
    ("object_rel_direction_hard", ["front.*(left|right)", "back.*(left|right)"]),
    ("object_rel_distance", ["(closer|closer to|nearest|farthest)", "which.*closest"]),
    ("obj_appearance_order", ["first.*appear", "order.*appear", "sequence"]),
    ("route_planning", ["how.*get.*from.*to", "path.*from", "route", "walk.*from"]),
]
