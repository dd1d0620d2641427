"""Physical constants and grid definitions."""

# Fixed values.
TC_PER_TBM = 0.5
TCO2_PER_TC = 3.67
POOL_CARBON = {"agb": 0.47, "bgb": 0.47, "dead_wood": 0.47, "litter": 0.37}
SQM_PER_HA = 10000.0
EARTH_RADIUS_M = 6.371e6
FIRE_FACTORS = {"savanna": 1.613, "tropics": 1.580, "extratropics": 1.569}
SPEED_OF_LIGHT = 299792458.0
NS_TO_S = 1e-9
METRES_PER_DEGREE = 110574.2727
FIRE_RADIUS_M = 375.0
PIXEL_DEG = 0.00025
TILE_DEG = 10
TILE_PIXELS = 40000
COARSE_FACTOR = 100
EPOCH_2000_NOON = 946728000
CHANGE_F_THRESHOLD = 11.81
CHANGE_P_THRESHOLD = 0.05
FOREST_CLASSES = (1, 2, 3, 4, 5, 8, 9)
SAVANNA_CLASSES = (8, 9)
MONTH_DAYS = (31, 28.25, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
