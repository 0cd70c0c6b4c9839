"""Norm tables: fixed values taken from building codes, OSM conventions and the data dictionary.

Everything here is a plain constant; the Column code that applies them lives in ``functions``.
"""

# --- provenance labels (fixed values) ---------------------------------------------------------
FACT = "факт"
DEFAULT = "умолчание"
OFFICIAL_ZONE = "официально"
CALCULATED_ZONE = "расчётно"
STATUS_OFFICIAL = "официальный"
STATUS_CALCULATED = "расчётный"
NEEDS_CLARIFICATION = "требует уточнения"
DIRECTORY_SOURCE = "справочник РСО"
OPERATOR_SOURCE = "OSM operator"

# --- OSM layers (fixed values) ----------------------------------------------------------------
LAYERS = (
    "osm_buildings", "osm_building_parts", "osm_roads", "osm_railways", "osm_railway_platforms",
    "osm_railway_crossings", "osm_water_areas", "osm_waterways", "osm_vegetation", "osm_power",
    "osm_landscaping", "osm_entrances",
)
SELECTION_MARGIN_M = 50.0

# --- buildings (fixed values) -----------------------------------------------------------------
DEFAULT_BUILDING_TYPE = "yes"
DEFAULT_BUILDING_LEVELS = 1
DEFAULT_HIGHWAY_CLASS = "unclassified"
SOURCE_OSM = "OSM"
SOURCE_EXTERNAL = "Overture"
SOURCE_BY_TYPE = "тип (умолчание)"
HEIGHT_BY_TYPE_M = {
    "house": 8.0, "detached": 8.0, "apartments": 25.0, "residential": 18.0, "industrial": 10.0,
    "warehouse": 8.0, "retail": 6.0, "commercial": 9.0, "garage": 3.0, "garages": 3.0, "shed": 3.0,
}
HEIGHT_FALLBACK_M = 9.0
LEVEL_HEIGHT_M = 3.0
ROOF_ALLOWANCE_M = 1.0
MIN_FOOTPRINT_AREA_M2 = 1.0
ENTRANCE_SNAP_M = 1.0
ROOF_SHAPES = ("gabled", "hipped", "pyramidal", "skillion")
DEFAULT_ROOF_ANGLE_DEG = 30.0

# --- roads (fixed values) ---------------------------------------------------------------------
ROAD_WIDTH_BY_CLASS_M = {
    "motorway": 15.0, "trunk": 12.0, "primary": 10.0, "secondary": 9.0, "tertiary": 7.0,
    "residential": 6.0, "living_street": 5.0, "service": 4.0, "track": 3.0, "pedestrian": 4.0,
    "footway": 1.5, "cycleway": 2.0, "path": 1.0,
}
ROAD_WIDTH_DEFAULT_M = 5.0
NETWORK_BACKBONE = "каркасная"
NETWORK_INTERNAL = "внутриквартальная"
BACKBONE_CLASSES = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link",
    "secondary", "secondary_link", "tertiary", "tertiary_link",
)
UNPAVED_SURFACES = (
    "unpaved", "compacted", "fine_gravel", "gravel", "shells", "rock", "pebblestone", "ground",
    "dirt", "earth", "mud", "laterite", "grass", "sand", "woodchips", "snow", "ice", "salt",
)
GRASS_VERGE_LANE = "Buffer(Verge)"
CURB_WIDTH_M = 0.15
LANE_WIDTH_M = 3.0
ROAD_CORRIDOR_DEFAULT_M = 6.0
BRIDGE_CLEARANCE_ROAD_M = 5.0
BRIDGE_CLEARANCE_RAIL_M = 6.0
PAVEMENT_CLEARANCE_M = 0.03
MARKING_CLEARANCE_M = 0.005
LANE_CROSS_SLOPE = 0.02
LANE_ELONGATION_RATIO = 1.5
LANE_PROFILE_STEP_M = 1.0
LANE_PROFILE_WINDOW_M = 15.0

# --- rail (fixed values) ----------------------------------------------------------------------
BALLAST_SHOULDER_M = 1.24
TRACK_SPACING_M = 4.5
GAUGE_DEFAULT_M = 1.520
BALLAST_DEFAULT_M = GAUGE_DEFAULT_M + 2 * BALLAST_SHOULDER_M
PLATFORM_LINE_WIDTH_M = 3.0
PLATFORM_HEIGHT_M = 0.3
CATENARY_SPACING_M = 50.0
CATENARY_OFFSET_M = 3.1

# --- power (fixed values) ---------------------------------------------------------------------
POLE_HEIGHT_M = 9.0
TOWER_HEIGHT_M = 20.0
POLE_MATERIAL_DEFAULT = "wood"
TOWER_MATERIAL_DEFAULT = "steel"
POLE_RADIUS_BY_MATERIAL_M = {"wood": 0.12, "concrete": 0.15, "steel": 0.10}
TOWER_RADIUS_BASE_M = 1.5
TOWER_RADIUS_TOP_M = 0.3
CALCULATED_POLE_SPACING_M = 60.0
POLE_SNAP_M = 3.0
CABLES_DEFAULT = 3
PHASE_SPACING_M = 1.5
WIRE_ATTACHMENT_RATIO = 0.9
SAG_RATIO = 0.03
WIRE_SAMPLES = 8
SUBSTATION_HEIGHT_M = 4.0
POWER_CORRIDOR_M_BY_KV = (
    (1.0, 2.0), (20.0, 10.0), (35.0, 15.0), (110.0, 20.0), (220.0, 25.0), (500.0, 30.0),
    (750.0, 40.0), (1150.0, 55.0),
)

# --- water (fixed values) ---------------------------------------------------------------------
WATERWAY_WIDTH_M = 3.0
WATER_ELONGATION_RATIO = 3.0
WATER_PROFILE_STEP_M = 5.0
WATER_PROFILE_WINDOW_M = 50.0

# --- plants and street furniture (fixed values) -----------------------------------------------
LEAF_TYPE_LABELS = {"broadleaved": "лиственное", "needleleaved": "хвойное", "mixed": "смешанное"}
TREE_SPECIES_DEFAULT = "лиственное (умолчание)"
TREE_HEIGHT_DEFAULT_M = 12.0
FOREST_DENSITY_PER_HA = {"needleleaved": 500.0, "mixed": 400.0, "broadleaved": 350.0}
FOREST_DENSITY_DEFAULT_PER_HA = 400.0
SHRUB_DENSITY_PER_HA = 1500.0
SHRUB_HEIGHT_M = 1.2
FENCE_HEIGHT_M = 1.5
WALL_HEIGHT_M = 2.0
WALL_THICKNESS_M = 0.2
FENCE_RAIL_WIDTH_M = 0.05
FENCE_POST_SPACING_M = 2.5
LAMP = {"pole_height_m": 6.0, "pole_radius_m": 0.08, "head_radius_m": 0.15, "head_height_m": 0.3}
BENCH = {"length_m": 1.5, "depth_m": 0.5, "seat_height_m": 0.45}

# --- legal zones and norms (fixed values) -----------------------------------------------------
CEMETERY_M_BY_HA = ((10.0, 50.0), (20.0, 100.0), (40.0, 300.0))
WATER_PROTECTION_M_BY_KM = ((10.0, 50.0), (50.0, 100.0), (float("inf"), 200.0))
NETWORK_ZONE_M = {
    "В": ((300.0, 5.0), (1_000_000.0, 10.0)),
    "К": ((300.0, 5.0), (1_000_000.0, 10.0)),
    "Т": ((1_000_000.0, 3.0),),
    "Г": ((300.0, 2.0), (1_000_000.0, 7.0)),
    "Кл": ((1_000_000.0, 1.0),),
}
NETWORK_LABELS = {
    "К": "канализация", "В": "водопровод", "Т": "теплосеть", "Г": "газопровод",
    "Кл": "кабельная линия",
}
NETWORK_WORDS = {
    "К": ("канализация", "канализационная", "sewer", "sewage"),
    "В": ("водопровод", "водопроводная", "водоснабжение", "water"),
    "Т": ("теплосеть", "теплотрасса", "heating", "heat"),
    "Г": ("газопровод", "газоснабжение", "газ", "gas"),
    "Кл": ("кабель", "кабельная", "электрокабель", "cable"),
}
NETWORK_DEPTH_M = {"К": 1.5, "В": 1.8, "Т": 0.7, "Г": 0.8, "Кл": 0.7}
PIPE_MATERIALS = (
    "сталь", "чугун", "пнд", "пвх", "полиэтилен", "железобетон", "асбестоцемент", "чугунная",
)
NORMATIVE_SOURCE = "нормативная"
LABEL_SNAP_M = 5.0
FIRE_DEGREES = ("I-II", "III", "IV-V")
FIRE_BREAK_M = {
    ("I-II", "I-II"): 6.0, ("I-II", "III"): 8.0, ("I-II", "IV-V"): 10.0,
    ("III", "III"): 8.0, ("III", "IV-V"): 10.0, ("IV-V", "IV-V"): 15.0,
}
APPLICATION_CHANNELS = ("письмо", "личный кабинет", "Госуслуги", "МФЦ")
NETWORK_CLEARANCE_M = 2.0
CHECK_ENVELOPE = "огибающая застройки"
CHECK_ZONE = "зона ограничения"
CHECK_NETWORK = "сети (горизонтальное расстояние)"
TU_SENT = "отправлен"
TU_RECEIVED = "получен"
TU_OVERDUE = "просрочен"
TU_DEADLINE_DAYS = 30

# --- relief (fixed values) --------------------------------------------------------------------
DEGENERATE_AREA_M2 = 1e-6
TRANSITION_WIDTH_M = 40.0
SLOPE_RATIO = 1.5
MAX_SLOPE_RUN_M = 5.0
POINT_SOURCE_PRIORITY = {"building": 3, "water": 2, "road": 1, "terrain": 0}

# --- tiles (fixed values) ---------------------------------------------------------------------
TILE_SIZE_M = 250.0
LOD_LIMITS_M = (("LOD2", 500.0), ("LOD1", 1500.0), ("LOD0", 3000.0))
LOD_STEP_M = {"LOD2": 1.0, "LOD1": 5.0, "LOD0": 15.0}
EARTH_CIRCUMFERENCE_M = 40_075_016.685_578_5
TERRAIN_RGB_BASE_M = -10_000.0
TERRAIN_RGB_STEP_M = 0.1

# --- audit (fixed values) ---------------------------------------------------------------------
GOOD_RATIO = 0.8
POOR_RATIO = 0.4
DECISIONS = ("достаточно", "дополнить вручную", "нужен другой источник")

# --- projection: zone, central meridian, false easting, false northing (fixed values) ---------
MSK_ZONES = (
    (1, 53.55, 1_250_000.0, -5_914_743.504),
    (2, 56.55, 2_250_000.0, -5_914_743.504),
    (3, 59.55, 3_250_000.0, -5_914_743.504),
)
MSK_HELMERT = (23.57, -140.95, -79.8, 0.0, 0.35, 0.79, -0.22)
MSK_MAX_OFFSET_DEG = 2.0
WGS84_ELLIPSOID = (6378137.0, 298.257223563)
KRASSOVSKY_ELLIPSOID = (6378245.0, 298.3)

# --- jobs (fixed values) ----------------------------------------------------------------------
STEP_NAMES = (
    "select_osm", "fetch_cadastre", "prepare_relief", "select_and_normalize", "assemble_ifc",
    "convert_to_glb", "generate_tileset", "package_outputs",
)
RADIUS_LIMITS_M = (500.0, 3000.0)
