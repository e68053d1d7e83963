"""Fixed values of the domain: vocabularies, label maps and weights. The lists are the
contract of the extractors and stand as they must, in their order."""

# Attack, weapon and target categories with their terms.
ATTACK = {
    "Bombing": ["bomb", "bombing", "blast", "explosion", "exploded", "detonated", "detonation", "ied", "car bomb", "suicide bomb", "truck bomb", "improvised explosive", "suicide bomber", "explosive device", "explosive vest"],
    "Armed Assault": ["shooting", "gunfire", "gunmen", "opened fire", "shot dead", "armed assault", "armed attack", "firefight", "shoot-out", "gunshot", "machine gun", "rifle fire", "fired upon", "fired on", "stormed", "breached", "assault", "armed militants", "armed attackers", "attacked", "gunfight", "encounter"],
    "Kidnapping": ["kidnap", "kidnapping", "abducted", "abduction", "taken hostage", "hostage", "seized", "captured"],
    "Assassination": ["assassination", "assassinated", "targeted killing", "shot and killed", "gunned down"],
    "Hijacking": ["hijack", "hijacking", "hijacked", "commandeered", "took control of"],
    "Arson": ["arson", "set fire", "set ablaze", "torched", "firebomb", "burned down", "set on fire", "vandalized", "sabotage", "destroyed", "damaged"],
    "Stabbing": ["stabbing", "stabbed", "knife attack", "machete", "slashing", "hacked"],
    "Unarmed Assault": ["unarmed assault", "beaten", "punched", "kicked", "assaulted with bare hands", "mob violence", "lynched"],
}
WEAPON = {
    "Explosives": ["bomb", "explosive", "ied", "dynamite", "tnt", "grenade", "landmine", "mine", "detonator", "c4", "semtex", "improvised explosive device", "grenades", "blasts", "explosive device", "explosive vest", "suicide vest", "rocket launcher", "rocket launchers", "rpg", "blast"],
    "Firearms": ["gun", "rifle", "pistol", "ak-47", "ak47", "firearm", "machine gun", "assault rifle", "assault rifles", "shotgun", "automatic weapon", "automatic weapons", "kalashnikov", "ammunition", "bullets", "opened fire", "fired upon", "fired on", "firing", "gunfire", "gunmen", "gunshot", "gunfight", "armed with", "armed militants", "armed attackers", "shooting"],
    "Melee": ["knife", "machete", "sword", "axe", "blade", "dagger", "sharp weapon", "blunt object"],
    "Vehicle": ["car bomb", "truck bomb", "vbied", "vehicle-borne", "rammed", "vehicle attack", "ramming attack", "drove into"],
    "Chemical": ["chemical", "nerve agent", "sarin", "mustard gas", "chlorine", "toxic gas", "poison gas", "poison", "acid", "chemical agent"],
    "Incendiary": ["molotov", "firebomb", "incendiary", "petrol bomb"],
    "Sabotage Equipment": ["sabotage equipment", "tools", "wrench", "bolt cutter"],
}
TARGET = {
    "Military": ["military", "soldier", "soldiers", "troops", "barracks", "naval", "defense", "defence", "checkpoint", "convoy", "military convoys", "patrol", "army camp", "army base", "air force base", "jawans", "cadets"],
    "Government": ["government", "parliament", "embassy", "consulate", "police", "police station", "courthouse", "minister", "official", "diplomat", "prison", "checkpoints"],
    "Religious": ["church", "mosque", "temple", "synagogue", "shrine", "cathedral", "religious", "worship", "prayer", "pilgrim", "pilgrims", "pilgrimage", "religious buildings"],
    "Civilian": ["civilian", "civilians", "market", "marketplace", "shops", "stores", "passenger", "passengers", "commuter", "commuters", "crowd", "crowds", "gathering", "festival", "concert", "school", "schools", "university", "universities", "colleges", "hospital", "hotel", "bank", "factory", "restaurant", "cafe", "shopping", "business", "families", "children", "people", "foreign nationals", "nationals", "spectators"],
    "Infrastructure": ["infrastructure", "pipeline", "power plant", "dam", "bridge", "railway", "port", "telecom", "power stations", "telecom towers", "pylon", "oil facility", "refinery", "utilities"],
    "Media": ["journalist", "reporter", "media", "newspaper", "news agency", "press", "broadcaster"],
    "Transportation": ["bus", "train", "airplane", "aircraft", "flight", "ferry", "ship", "subway", "metro", "airport", "railway station", "terminus"],
}

# The event scorer's terms and weights.
CORE_VERBS = ["encounter", "killed", "attacked", "bombing", "bombed", "blast", "explosion", "exploded", "ambush", "ambushed", "suicide attack", "suicide bombing", "opened fire", "grenade attack", "terrorist attack"]
EVENT_TERMS = [
    (2.0, ["attack", "attacked", "bombing", "bombed", "blast", "explosion", "exploded", "firing", "fired upon", "opened fire", "encounter", "ambush", "ambushed", "suicide attack", "suicide bombing", "grenade attack", "terrorist attack", "assault", "assaulted", "raid", "raided", "hostage", "infiltration", "stormed", "clashed", "clash", "detonated", "detonation", "kidnapped", "abducted", "assassinated", "set fire", "torched", "arson", "intercepted"]),
    (1.5, ["killed", "injured", "wounded", "dead", "died", "fatalities", "casualties", "martyred"]),
    (1.0, ["bomb", "grenade", "explosive", "ied", "rifle", "firearm", "ak-47", "ak47", "rpg", "gun", "pistol", "machine gun", "ammunition", "landmine", "mine", "dynamite", "detonator", "rocket launcher", "suicide vest", "explosive vest", "arms", "weapons"]),
    (1.0, ["bombing", "armed assault", "kidnapping", "assassination", "hijacking", "stabbing", "car bomb", "truck bomb"]),
    (0.5, ["military", "army", "police", "civilian", "convoy", "camp", "base", "barracks", "checkpoint", "patrol", "jawans", "cadets", "soldiers", "troops", "personnel"]),
]
CORE_BONUS = 3.0
ADMIN_TERMS = [
    (3.0, ["investigation revealed", "investigation disclosed", "further investigation", "investigation has revealed", "conspiracy investigation", "investigation established", "investigation conducted", "course of investigation", "during investigation", "investigation so far"]),
    (3.0, ["charge-sheet", "chargesheet", "charge sheet", "re-registered", "fir no", "court proceedings", "prosecution", "charge stands abated", "supplementary charge-sheet", "supplementary chargesheet", "prosecution sanction", "under sections", "under section", "ua(p) act", "uapa", "nsa act", "explosive substances act"]),
    (2.0, ["accused persons", "accused no", "a-1", "a-2", "a-3", "a-4", "a-5", "a-6", "a-7", "a-8", "a-9", "a-10", "list of accused", "names of accused", "absconding accused", "arrested accused"]),
    (1.5, ["nia court", "sessions court", "special court", "judicial custody", "trial court", "bail", "remand", "hearing"]),
    (2.0, ["leadership handlers", "logistic support", "overground workers", "ogw", "handlers", "conspired", "conspiracy hatched", "radicalised", "radicalised online", "recruited", "recruitment", "facilitated the movement", "provided shelter", "harboured"]),
]
ADMIN_CASED = (3.0, ["FIR", "IPC"])

# Anchors and narrative boundaries of the clusterer.
ATTACK_ANCHORS = ["attack", "attacked", "ambush", "ambushed", "bombing", "bombed", "explosion", "exploded", "opened fire", "grenade attack", "kidnapping", "kidnapped", "abduction", "abducted", "assassination", "assassinated", "arson", "set fire", "torched", "blast", "clash", "clashed"]
OPERATION_ANCHORS = ["encounter", "raid", "raided", "search operation", "neutralized", "arrested", "detained"]
OTHER_ANCHORS = ["killed", "injured", "wounded", "fatalities", "casualties", "dead", "died", "ied", "grenade", "explosive", "mine", "rpg", "ak-47", "rifle", "firearm"]
BOUNDARIES = ["meanwhile", "separately", "elsewhere", "in a separate incident", "another attack", "additionally", "in another incident"]

# Query classes, in order of precedence, and phrases of broad questions.
QUERY_CLASSES = {
    "enumeration": ["list", "show all", "enumerate", "find all"],
    "comparison": ["compare", "comparison", "versus", "vs", "difference between", "similarities between"],
    "factual": ["how many", "count", "who was", "who is", "who are", "what was", "what is", "what are", "when did", "when was", "where did", "where was", "how did", "how was", "who carried", "who attacked", "responsible"],
}
BROAD = ["most common", "top", "trend", "trends", "across india", "nationwide", "statistics", "statistical", "frequency", "distribution"]

# Words of queries and the labels they ask for, in order.
QUERY_ATTACK = {
    "bombing": "Bombing/Explosion", "bomb": "Bombing/Explosion", "explosion": "Bombing/Explosion", "ied": "Bombing/Explosion", "blast": "Bombing/Explosion", "armed assault": "Armed Assault", "shooting": "Armed Assault", "gunfire": "Armed Assault", "ambush": "Armed Assault",
    "assassination": "Assassination", "kidnapping": "Hostage Taking (Kidnapping)", "kidnap": "Hostage Taking (Kidnapping)", "abduction": "Hostage Taking (Kidnapping)", "hostage": "Hostage Taking (Barricade Incident)", "hijacking": "Hijacking", "hijack": "Hijacking",
    "arson": "Facility/Infrastructure Attack", "sabotage": "Facility/Infrastructure Attack",
}
QUERY_TARGET = {
    "police": "Police", "military": "Military", "army": "Military", "soldier": "Military", "soldiers": "Military", "civilian": "Private Citizens & Property", "civilians": "Private Citizens & Property", "government": "Government (General)",
    "school": "Educational Institution", "college": "Educational Institution", "university": "Educational Institution", "mosque": "Religious Figures/Institutions", "temple": "Religious Figures/Institutions", "church": "Religious Figures/Institutions", "religious": "Religious Figures/Institutions",
    "bus": "Transportation", "train": "Transportation", "railway": "Transportation", "airport": "Airports & Aircraft", "journalist": "Journalists & Media", "media": "Journalists & Media", "tourist": "Tourists", "tourists": "Tourists",
}
QUERY_WEAPON = {
    "explosive": "Explosives", "explosives": "Explosives", "bomb": "Explosives", "firearm": "Firearms", "firearms": "Firearms", "gun": "Firearms", "guns": "Firearms", "rifle": "Firearms", "grenade": "Explosives", "knife": "Melee", "machete": "Melee", "melee": "Melee", "incendiary": "Incendiary", "chemical": "Chemical",
}
DOCUMENT_WORDS = ["parliament", "embassy", "consulate", "airport", "hospital", "hotel", "market", "temple", "mosque", "church", "station", "crpf", "bsf", "itbp", "cisf", "rpf", "suicide", "grenade"]

# Source labels and the categories that count as right for them.
LABEL_MAPS = {
    "attack": {"Bombing/Explosion": ["Bombing"], "Armed Assault": ["Armed Assault"], "Assassination": ["Assassination"], "Facility/Infrastructure Attack": ["Arson", "Bombing"], "Hostage Taking (Kidnapping)": ["Kidnapping"], "Hijacking": ["Hijacking"], "Unarmed Assault": ["Unarmed Assault"]},
    "weapon": {
        "Explosives": ["Explosives"], "Firearms": ["Firearms"], "Incendiary": ["Incendiary"], "Melee": ["Melee"], "Chemical": ["Chemical"], "Vehicle (not to include vehicle-borne explosives, i.e., car or truck bombs)": ["Vehicle"],
        "Sabotage Equipment": ["Sabotage Equipment"],
    },
    "target": {
        "Military": ["Military"], "Police": ["Government"], "Government (General)": ["Government"], "Government (Diplomatic)": ["Government"], "Private Citizens & Property": ["Civilian"], "Business": ["Civilian"], "Educational Institution": ["Civilian"],
        "NGO": ["Civilian"], "Tourists": ["Civilian"], "Religious Figures/Institutions": ["Religious"], "Utilities": ["Infrastructure"], "Telecommunication": ["Infrastructure"], "Journalists & Media": ["Media"], "Transportation": ["Transportation"],
        "Airports & Aircraft": ["Transportation"], "Maritime": ["Transportation"],
    },
}
# Rows that the full coded dataset has.
EXPECTED_ROWS = {"full": 181691, "summary": 115562, "country": 11960, "country_summary": 9097}
# Weights of the sentence clusterer.
CLUSTER = {"threshold": 0.5, "loc": 0.35, "date": 0.25, "actor": 0.20, "attack": 0.10, "prox": 0.10}
