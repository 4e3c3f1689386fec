"""Column layouts and fixed vocabularies.

Operators take column names as arguments; a ``Layout`` bundles the names of
one dataset so callers do not repeat them.  Two layouts ship:

* ``UK_COLLISIONS`` - the original 33-column collision CSV (raw names).
* ``SURROGATE`` - the collision-shaped view that ``sources.surrogate`` derives
  from the ``lineitem`` table (snake_case names, no weather/surface columns).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the study's own vocabularies for results to
# match; they are stated here once, in natural order.
# ---------------------------------------------------------------------------

RANDOM_STATE = 42
CLASS_NAMES = ("Fatal", "Serious", "Slight")           # label 0, 1, 2; class 0 is rare
TARGET_MAP = {1: 0, 2: 1, 3: 2}                         # source severity code -> label
SEVERITY_MAP = {1: "Fatal", 2: "Serious", 3: "Slight"}
DAY_MAP = {1: "Sunday", 2: "Monday", 3: "Tuesday", 4: "Wednesday",
           5: "Thursday", 6: "Friday", 7: "Saturday"}
DAY_ORDER = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
SEASON_MAP = {1: "Winter", 2: "Winter", 3: "Spring", 4: "Spring", 5: "Spring", 6: "Summer",
              7: "Summer", 8: "Summer", 9: "Fall", 10: "Fall", 11: "Fall", 12: "Winter"}
SEASON_ORDER = ("Winter", "Spring", "Summer", "Fall")
MONTH_ABBR = ("Jan", "Feb", "Mar", "Apr", "May", "Jun",
              "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
RUSH_HOURS = (7, 8, 9, 16, 17, 18)
FIRST_ROAD_CLASS_MAP = {1: "Motorway", 2: "A(M)", 3: "A", 4: "B", 5: "C", 6: "Unclassified"}
SECOND_ROAD_CLASS_MAP = {-1: "No second road", 1: "Motorway", 2: "A(M)", 3: "A",
                         4: "B", 5: "C", 6: "Unclassified"}
URBAN_RURAL_MAP = {1: "Urban", 2: "Rural", 3: "Unallocated"}

# Display labels for coded model inputs ("{code} — {label}").
CATEGORY_LABELS = {
    "Road_Type": {1: "Roundabout", 2: "One-way street", 3: "Dual carriageway",
                  6: "Single carriageway", 7: "Slip road", 9: "Unknown"},
    "Light_Conditions": {1: "Daylight", 4: "Dark: lights lit", 5: "Dark: lights unlit",
                         6: "Dark: no lighting", 7: "Dark: unknown lighting"},
    "Weather_Conditions": {1: "Fine", 2: "Rain", 3: "Snow", 4: "Fine + high winds",
                           5: "Rain + high winds", 6: "Snow + high winds", 7: "Fog/mist",
                           8: "Other", 9: "Unknown"},
    "Road_Surface_Conditions": {1: "Dry", 2: "Wet/damp", 3: "Snow", 4: "Frost/ice",
                                5: "Flood", 9: "Unknown"},
    "1st_Road_Class": {1: "Motorway", 2: "A(M)", 3: "A", 4: "B", 5: "C", 6: "Unclassified"},
    "2nd_Road_Class": {-1: "No second road", 1: "Motorway", 2: "A(M)", 3: "A",
                       4: "B", 5: "C", 6: "Unclassified"},
    "Day_of_Week": {1: "Sunday", 2: "Monday", 3: "Tuesday", 4: "Wednesday",
                    5: "Thursday", 6: "Friday", 7: "Saturday"},
    "Urban_or_Rural_Area": {1: "Urban", 2: "Rural", 3: "Unallocated"},
    "rush_hour": {0: "No", 1: "Yes"},
}
LABEL_SEPARATOR = " — "

# Strings the pandas CSV reader turns into missing values by default.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
               "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
               "n/a", "nan", "null")

# Raw CSV column contract, in file order.
UK_COLUMNS = (
    "Unnamed: 0", "Accident_Index", "Location_Easting_OSGR", "Location_Northing_OSGR",
    "Longitude", "Latitude", "Police_Force", "Accident_Severity", "Number_of_Vehicles",
    "Number_of_Casualties", "Date", "Day_of_Week", "Time", "Local_Authority_(District)",
    "Local_Authority_(Highway)", "1st_Road_Class", "1st_Road_Number", "Road_Type",
    "Speed_limit", "Junction_Control", "2nd_Road_Class", "2nd_Road_Number",
    "Pedestrian_Crossing-Human_Control", "Pedestrian_Crossing-Physical_Facilities",
    "Light_Conditions", "Weather_Conditions", "Road_Surface_Conditions",
    "Special_Conditions_at_Site", "Carriageway_Hazards", "Urban_or_Rural_Area",
    "Did_Police_Officer_Attend_Scene_of_Accident", "LSOA_of_Accident_Location", "Year",
)
UK_LONG_COLUMNS = ("Unnamed: 0", "Police_Force", "Accident_Severity", "Number_of_Vehicles",
                   "Number_of_Casualties", "Day_of_Week", "Local_Authority_(District)",
                   "1st_Road_Class", "1st_Road_Number", "Speed_limit", "2nd_Road_Class",
                   "2nd_Road_Number", "Urban_or_Rural_Area", "Year")
UK_DOUBLE_COLUMNS = ("Location_Easting_OSGR", "Location_Northing_OSGR", "Longitude", "Latitude")

# Columns removed by the analytical contract.
UK_DROP_COLUMNS = (
    "Accident_Index", "Unnamed: 0", "Location_Easting_OSGR", "Location_Northing_OSGR",
    "Longitude", "Latitude", "Local_Authority_(District)", "Local_Authority_(Highway)",
    "1st_Road_Number", "2nd_Road_Number", "Pedestrian_Crossing-Human_Control",
    "Special_Conditions_at_Site", "Carriageway_Hazards", "LSOA_of_Accident_Location", "Year",
    "Junction_Control", "Police_Force", "Number_of_Vehicles", "Number_of_Casualties",
    "Did_Police_Officer_Attend_Scene_of_Accident",
)
UK_POST_COLLISION = ("Number_of_Vehicles", "Number_of_Casualties",
                     "Did_Police_Officer_Attend_Scene_of_Accident")
UK_IDENTIFIERS = ("Accident_Index", "Unnamed: 0")
UK_GEOGRAPHY = ("Location_Easting_OSGR", "Location_Northing_OSGR", "Longitude", "Latitude")
UK_HIGH_CARDINALITY = ("Local_Authority_(District)", "Local_Authority_(Highway)",
                       "1st_Road_Number", "2nd_Road_Number", "LSOA_of_Accident_Location",
                       "Police_Force")

# Removal rationale strings, first matching group wins.
REASON_POST_COLLISION = "Post-collision field excluded to prevent target leakage"
REASON_IDENTIFIER = "Row index or collision identifier; not an analytical feature"
REASON_GEOGRAPHY = "Geographic coordinate excluded from the analytical feature contract"
REASON_HIGH_CARDINALITY = "High-cardinality geographic or administrative identifier"
REASON_OTHER = ("Excluded by the current analytical feature contract; "
                "no narrower rationale documented")
REASON_RETAINED = "Retained for cleaning or EDA"

# Names of the nine domain checks, in report order.
CHECK_SEVERITY = "Severity outside {1, 2, 3}"
CHECK_WEEKDAY = "Day of week outside 1-7"
CHECK_FIRST_ROAD = "First road class outside 1-6"
CHECK_SECOND_ROAD = "Second road class outside {-1, 1, ..., 6}"
CHECK_SPEED = "Non-positive speed limit"
CHECK_AREA = "Urban/rural code outside {1, 2, 3}"
CHECK_DATE = "Unparseable date"
CHECK_TIME = "Unparseable non-missing time"
CHECK_BLANK = "Blank retained string value"

# Names of the reconciliation metrics, in report order.
AUDIT_METRICS = (
    "Raw rows",
    "Raw columns",
    "Duplicate substantive rows removed",
    "Rows after substantive deduplication",
    "Rows with missing values in any raw field",
    "Deduplicated rows with missing values in retained fields",
    "Rows removed by complete-case cleaning",
    "Cleaned rows",
    "Retained source columns before feature derivation",
    "Derived analytical columns",
    "Rows with a repeated Accident_Index",
    "Rows with scientific-notation Accident_Index",
)

# Model inputs that happen after the outcome (never valid features).
UK_FORBIDDEN = ("Number_of_Vehicles", "Number_of_Casualties",
                "Did_Police_Officer_Attend_Scene_of_Accident", "Accident_Severity")
HOUR_SOURCE = "Hour_of_Day"          # display name of (hour_sin, hour_cos)
DEFAULT_THRESHOLD_GRID = 201          # linspace(0, 1, 201)
CLASS_PAIRS = ((0, 1), (0, 2), (1, 2))


@dataclass(frozen=True)
class Layout:
    """Names of the roles a collision-shaped table plays.

    ``None`` marks a role the table does not have; operators skip it.
    """

    row_id: str
    identifier: str | None
    severity: str
    date: str
    time: str
    day_of_week: str
    first_road_class: str
    second_road_class: str
    road_type: str
    speed_limit: str
    crossing: str
    light: str
    area: str
    weather: str | None
    surface: str | None
    year: str | None
    non_substantive: tuple[str, ...]
    drop_columns: tuple[str, ...]
    forbidden: tuple[str, ...]
    post_collision: tuple[str, ...] = ()
    identifiers: tuple[str, ...] = ()
    geography: tuple[str, ...] = ()
    high_cardinality: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)
    #: ``row_id`` is made of the substantive values, since the source has no number of its own that is unique.
    row_id_from_values: bool = False

    @property
    def categorical_inputs(self) -> list[str]:
        """One-hot model inputs (Season is added by the time stage)."""
        names = [self.road_type, self.light, self.weather, self.surface,
                 self.first_road_class, self.second_road_class, self.crossing,
                 self.day_of_week, self.area]
        return [n for n in names if n is not None] + ["Season"]

    @property
    def numeric_inputs(self) -> list[str]:
        return [self.speed_limit, "hour_sin", "hour_cos", "rush_hour"]

    @property
    def model_inputs(self) -> list[str]:
        return self.categorical_inputs + self.numeric_inputs

    def label_maps(self) -> dict[str, dict]:
        """Per input column, the code -> display-label map (keys as strings)."""
        by_role = {
            self.road_type: CATEGORY_LABELS["Road_Type"],
            self.light: CATEGORY_LABELS["Light_Conditions"],
            self.weather: CATEGORY_LABELS["Weather_Conditions"],
            self.surface: CATEGORY_LABELS["Road_Surface_Conditions"],
            self.first_road_class: CATEGORY_LABELS["1st_Road_Class"],
            self.second_road_class: CATEGORY_LABELS["2nd_Road_Class"],
            self.day_of_week: CATEGORY_LABELS["Day_of_Week"],
            self.area: CATEGORY_LABELS["Urban_or_Rural_Area"],
            "rush_hour": CATEGORY_LABELS["rush_hour"],
        }
        return {k: {str(code): label for code, label in v.items()}
                for k, v in by_role.items() if k is not None}


UK_COLLISIONS = Layout(
    row_id="row_key", row_id_from_values=True, identifier="Accident_Index", severity="Accident_Severity",
    date="Date", time="Time", day_of_week="Day_of_Week", first_road_class="1st_Road_Class",
    second_road_class="2nd_Road_Class", road_type="Road_Type", speed_limit="Speed_limit",
    crossing="Pedestrian_Crossing-Physical_Facilities", light="Light_Conditions",
    area="Urban_or_Rural_Area", weather="Weather_Conditions",
    surface="Road_Surface_Conditions", year="Year",
    non_substantive=("Unnamed: 0",), drop_columns=UK_DROP_COLUMNS, forbidden=UK_FORBIDDEN,
    post_collision=UK_POST_COLLISION, identifiers=UK_IDENTIFIERS, geography=UK_GEOGRAPHY,
    high_cardinality=UK_HIGH_CARDINALITY,
)

SURROGATE = Layout(
    row_id="row_index", identifier="accident_index", severity="severity_code",
    date="date_str", time="time_str", day_of_week="day_of_week",
    first_road_class="first_road_class", second_road_class="second_road_class",
    road_type="road_type", speed_limit="speed_limit", crossing="crossing", light="light",
    area="area", weather=None, surface=None, year="src_year",
    non_substantive=("row_index",),
    drop_columns=("accident_index", "location_e6", "number_of_vehicles", "src_year"),
    forbidden=("number_of_vehicles", "severity_code"),
    post_collision=("number_of_vehicles",), identifiers=("accident_index", "row_index"),
    geography=("location_e6",), high_cardinality=(),
)

#: Fixed values of the published table: size of its file, rows, years, classes.
UK_FACTS = {
    "size_bytes": 449_667_447,
    "raw_rows": 1_504_150,
    "duplicate_rows": 34_155,
    "cleaned_rows": 1_469_845,
    "years": (2005, 2006, 2007, 2009, 2010, 2011, 2012, 2013, 2014),
    "class_counts": {1: 19_039, 2: 198_894, 3: 1_251_912},
    "train_rows": 1_175_876,
    "test_rows": 293_969,
    "test_class_counts": {1: 3_808, 2: 39_779, 3: 250_382},
}
