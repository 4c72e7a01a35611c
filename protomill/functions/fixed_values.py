"""Names, patterns and limits that results depend on, as the data format defines them."""

from __future__ import annotations

# Groups of laboratory assets and the aliases that stand for them.
MATCH_GROUPS: dict[str, tuple[str, ...]] = {
    "cell_dish": ("cell dish", "cell dishes", "cell culture dish", "cell culture dishes", "culture dish", "culture dishes", "petri dish", "petri dishes"),
    "microcentrifuge_tube_1_5ml": (
        "microcentrifuge tube", "microcentrifuge tubes", "eppendorf tube", "eppendorf tubes", "1.5 ml tube", "1.5 ml tubes",
        "1.5 ml microcentrifuge tube", "1.5 ml centrifuge tube", "1.5 ml screw cap tube",
    ),
    "centrifuge_tube_10ml": ("10 ml centrifuge tube", "10 ml centrifuge tubes", "10ml centrifuge tube", "10 ml tube", "10 ml tubes"),
    "centrifuge_tube_15ml": (
        "15 ml centrifuge tube", "15 ml centrifuge tubes", "15ml centrifuge tube", "15 ml conical tube", "15 ml conical tubes",
        "15ml conical tube", "15 ml falcon tube", "15 ml falcon tubes",
    ),
    "centrifuge_tube_50ml": (
        "50 ml centrifuge tube", "50 ml centrifuge tubes", "50ml centrifuge tube", "50 ml conical tube", "50 ml conical tubes",
        "50ml conical tube", "50 ml falcon tube", "50 ml falcon tubes", "falcon tube", "falcon tubes",
    ),
    "cryovial": ("cryovial", "cryovials", "cryo vial", "cryo vials", "cryogenic vial", "cryogenic vials"),
    "pcr_plate": (
        "pcr plate", "pcr plates", "96 well pcr plate", "96 well pcr plates", "96 well plate", "96 well plates", "96 well microplate", "96 well microplates",
    ),
    "pipette_tip": (
        "pipette tip", "pipette tips", "micropipette tip", "micropipette tips", "200 ul tip", "200 ul tips", "200 ul pipette tip", "200 ul pipette tips",
    ),
    "pipette": ("pipette", "pipettes", "micropipette", "micropipettes", "single channel pipette", "single channel pipettes"),
    "tip_box": ("tip box", "tip boxes", "pipette tip box", "pipette tip boxes"),
    "pipette_rack": ("pipette rack", "pipette racks", "pipette holder", "pipette holders", "pipette stand", "pipette stands"),
    "tube_rack": (
        "tube rack", "tube racks", "centrifuge tube rack", "centrifuge tube racks", "microcentrifuge tube rack", "microcentrifuge tube racks",
        "test tube rack", "test tube racks",
    ),
    "centrifuge": (
        "centrifuge", "centrifuges", "microcentrifuge", "microcentrifuges", "bench centrifuge", "bench centrifuges", "refrigerated centrifuge",
        "refrigerated centrifuges",
    ),
    "thermal_cycler": ("thermal cycler", "thermal cyclers", "thermocycler", "thermocyclers", "pcr machine", "pcr machines"),
    "thermal_mixer": ("thermal mixer", "thermal mixers", "thermomixer", "thermomixers", "heat shaker", "heat shakers"),
    "vortex_mixer": ("vortex mixer", "vortex mixers", "vortexer", "vortexers", "vortex genie"),
    "beaker": ("beaker", "beakers", "glass beaker", "glass beakers"),
    "conical_bottle": ("conical bottle", "conical bottles", "erlenmeyer flask", "erlenmeyer flasks", "conical flask", "conical flasks"),
    "graduated_cylinder": ("graduated cylinder", "graduated cylinders", "measuring cylinder", "measuring cylinders"),
    "glass_rod": ("glass rod", "glass rods", "stirring rod", "stirring rods", "glass stirring rod", "glass stirring rods"),
    "drying_box": ("drying box", "drying boxes", "dry box", "dry boxes", "drying oven", "drying ovens", "drying chamber", "drying chambers"),
    "heating_device": (
        "hot plate", "hot plates", "heating plate", "heating plates", "heating device", "heating devices", "heat device", "heat devices", "heater", "heaters",
    ),
    "muffle_furnace": ("muffle furnace", "muffle furnaces", "laboratory furnace", "laboratory furnaces"),
}

# Patterns of the families of steps.
FAMILY_PATTERNS: dict[str, str] = {
    "transfer": r"\badd\b|\btransfer\b|\bpipett|\bdispens|\baliquot|\bload\b|\bapply\b|\bcombine\b",
    "mix": r"\bmix\b|\bvortex\b|\bshake\b|\bstir\b|\brock\b|\binvert\b",
    "incubate": r"\bincubat|\bstore\b|\bleave\b|\bhold\b|\brest\b|\bstand\b|\bdry\b|\bovernight\b",
    "centrifuge": r"centrifug|\bspin\b|\bx g\b|\brpm\b",
    "wash": r"\bwash\b|\brinse\b|\belut|\bpreclear",
    "separate": r"\bfilter\b|\bmagnet|\bpurif|\bcollect\b|\bseparat|\bpellet\b",
    "measure": r"\bmeasure\b|\bread\b|\bquantif|\bmonitor\b|\bnanodrop\b|\bscore\b",
    "device": r"\bopen\b|\bclose\b|\bbutton\b|\bpress\b|\blid\b|\bprogram\b|\bthermal cycler\b",
}
# Families whose repeats count, and those with the core bonus.
REPEAT_FAMILIES = ("transfer", "incubate", "centrifuge", "wash", "separate", "mix")
CORE_FAMILIES = ("transfer", "incubate", "centrifuge", "wash", "mix")
# Steps that are only headings.
GENERIC_HEADINGS = (
    r"^\s*(cleaning|preparation|mouse preparation|stereotaxic surgery|injection cannulas circuit preparation|apparatus preparation)\.?\s*$"
)
# Wordings that call for low-level actions.
LOW_LEVEL_PATTERN = r"\bopen the lid\b|\bclose the lid\b|\bpress\b|\bload .*?(?:rotor|bucket|slot)\b|\bbalance\b|\bseal\b"

# Actions by family, distractors, and low-level actions.
FAMILY_ACTIONS: dict[str, tuple[str, ...]] = {
    "transfer": ("add_reagent", "aliquot_sample", "transfer_liquid", "collect_fraction", "load_plate"),
    "mix": ("mix_sample", "vortex_mix", "stir_with_rod", "shake_container"),
    "incubate": ("incubate_sample", "heat_sample", "cool_sample", "set_thermal_mixer", "run_thermal_cycler", "dry_sample", "store_sample"),
    "centrifuge": ("centrifuge_sample",),
    "wash": ("wash_sample", "wash_pellet", "discard_supernatant", "aspirate_supernatant", "resuspend_pellet"),
    "separate": ("filter_sample", "magnetic_separate", "place_on_magnet", "collect_fraction"),
    "measure": ("measure_signal", "record_measurement"),
    "device": ("open_device", "close_device", "press_button", "open_thermal_cycler_lid", "close_thermal_cycler_lid", "seal_plate"),
    "manipulate": ("pick_container", "place_container", "pour_liquid"),
}
DISTRACTOR_ACTIONS = (
    "add_reagent", "transfer_liquid", "mix_sample", "incubate_sample", "centrifuge_sample", "discard_supernatant", "resuspend_pellet", "measure_signal",
)
LOW_LEVEL_ACTIONS = ("load_centrifuge_rotor", "pick_container", "place_container", "pour_liquid")

# Groups by how hard their items are, and entries that are left out.
PASSIVE_HOLDERS = ("tube_rack", "pipette_rack", "tip_box")
PASSIVE_CONTAINERS = (
    "cell_dish", "microcentrifuge_tube_1_5ml", "centrifuge_tube_10ml", "centrifuge_tube_15ml", "centrifuge_tube_50ml", "cryovial", "pcr_plate", "beaker",
    "conical_bottle", "graduated_cylinder",
)
ACTIVE_DEVICES = ("centrifuge", "thermal_cycler", "thermal_mixer", "vortex_mixer", "drying_box", "heating_device", "muffle_furnace")

# Words and phrases that validators look for.
SUSPICIOUS_TOKENS = ("autoclave", "parafilm", "manipulator", "gripper", "robot", "wrist", "sonicate", "coverslip", "muffle_furnace")
ZERO_ARGUMENT = r"\b(?:duration_[a-z]+|volume_[a-z]+|force_[a-z]+)\s*=\s*0(?:\.0+)?(?:[^.0-9a-z_]|$)"
SEQUENCE_CUES = ("already", "just", "after", "before", "previous", "prior", "then", "next")
# Words that tell equipment from reagents, by the kind of article.
EQUIPMENT_WORDS = ("centrifuge", "microscope", "incubator", "thermocycler", "cytometer", "spectrophotometer", "scanner")
TABLE_EQUIPMENT_WORDS = (
    "centrifuge", "microscope", "incubator", "thermocycler", "cytometer", "spectrophotometer", "scanner", "pipette", "pipettor", "shaker", "balance",
    "sonicator", "software", "camera", "printer", "oven", "hood", "freezer", "analyzer", "chamber", "filter holder", "system",
)
LISTED_EQUIPMENT_WORDS = (
    "centrifuge", "microscope", "incubator", "thermocycler", "cytometer", "spectrophotometer", "pipettor", "software", "heat block", "shaker", "sonicator",
    "scanner",
)
WIKI_EQUIPMENT_WORDS = (
    "centrifuge", "microscope", "incubator", "thermocycler", "cytometer", "spectrophotometer", "pipette", "pipettor", "shaker", "balance", "sonicator",
    "scanner", "freezer", "oven", "hood", "camera", "chamber",
)
EQUIPMENT_CATEGORIES = ("software", "equipment", "instrument", "other")

# The forms in which a reply names its answer, and the article captions and headers of a table of materials.
ANSWER_TAG = r"(?i)<answer>\s*([A-Z])\s*</answer>"
FINAL_ANSWER_LINE = r"(?i)^\s*Final\s+Answer\s*:\s*([A-Z])\s*$"
FREEFORM_ANSWERS = (
    r"(?i)<final_answer>\s*([A-Z])\s*</final_answer>",
    r"(?is)(?:final\s+answer|answer|correct\s+answer|correct\s+option)\s*(?:is|:|=)\s*([A-Z])\b",
    r"(?is)\boption\s*([A-Z])\s+is\s+correct\b",
)
MATERIALS_CAPTION = (
    r"(?i)table\s+of\s+materials|^\s*materials?\s*$|^\s*reagents?(\s+and\s+equipment)?\s*$|name\s+of\s+(material|reagent|equipment)"
)
MATERIALS_HEADER = r"name of (material|reagent|equipment)"
HEADER_CELLS = ("name", "reagent", "material")

# Where an article's XML holds its metadata.
ARTICLE_FIELDS: dict[str, str] = {
    "doi": r'<article-id pub-id-type="doi">([^<]+)</article-id>',
    "pmcid": r'<article-id pub-id-type="pmc(?:id)?">([^<]+)</article-id>',
    "pmid": r'<article-id pub-id-type="pmid">([^<]+)</article-id>',
    "title": r"(?s)<article-title[^>]*>(.*?)</article-title>",
    "journal": r"(?s)<journal-title[^>]*>(.*?)</journal-title>",
    "pub_year": r"(?s)<pub-date[^>]*>.*?<year>(\d{4})</year>",
    "abstract": r"(?s)<abstract[^>]*>(.*?)</abstract>",
}
LICENSE_LINK = r'(?s)<license[^>]*xlink:href="([^"]+)"'
LICENSE_TEXT = r"(?s)<license[^>]*>(.*?)</license>"
SURNAME = r"<surname>([^<]+)</surname>"
# What goes before a catalog number, what vendors and catalog numbers look like, and words before a reagent's name.
CATALOG_LEAD = r"^cat(?:alog)?[.\s#]*(?:number|no\.?|#)?\s*:?\s*"
CATALOG_NUMBER = r"^[A-Za-z0-9][A-Za-z0-9\-/.]{2,30}$"
CATALOG_ANY = r"^[A-Za-z0-9\-/.]+$"
CATALOG_ALONE = r"(?i)catalog\s*(?:number|no\.?|#)\s*[:\s]*([A-Za-z0-9\-/.]+)"
VENDOR_NAME = r"(?U)^[A-Z][\w .&'/-]{2,40}$"
VENDOR_ANY = r"(?iU)^[A-Z][\w .&'/-]+$"
LEAD_WORDS = ("using", "with", "from", "add", "the", "a", "an")
# Identifiers of a key resources table.
RESOURCE_ID = r"RRID\s*:\s*(\S+)"
RESOURCE_CATALOG = r"Cat#?\s*([A-Za-z0-9\-/.]+)"
# Headings of wiki pages that hold materials or steps, and those that never hold steps.
WIKI_MATERIALS = r"(?i)materials?|reagents?|equipment|supplies|solutions|apparatus"
WIKI_STEPS = r"(?i)procedure|protocol|steps?|method(s| for)?|workflow"
WIKI_NO_STEPS = (
    "contents", "curators", "abstract", "summary", "reference", "references", "note", "notes", "contact", "acknowledgment", "acknowledgments", "discussion",
    "discussions", "history", "see also", "external links", "specific protocols", "workflow", "overview", "introduction", "background", "critical steps",
    "troubleshooting", "safety",
)
WIKI_LICENSE = "https://creativecommons.org/licenses/by/3.0/"
# Tags of a reply's reasoning.
STEP_TAG = r"(?is)<step>(.*?)</step>"
REASONING_TAG = r"(?is)<reasoning>(.*?)</reasoning>"
