"""Table schemas, value domains and defaults shared by all operators."""

from pyspark.sql import types as T

MOVEMENT = T.StructType([
    T.StructField("move_date", T.DateType()),
    T.StructField("move_time", T.StringType()),  # HH:mm:ss
    T.StructField("plant_code", T.StringType()),
    T.StructField("move_type", T.StringType()),
    T.StructField("storage_loc", T.StringType()),
    T.StructField("partner_name", T.StringType()),
    T.StructField("partner_address", T.StringType()),
    T.StructField("product_code", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("batch", T.StringType()),
    T.StructField("qty", T.LongType()),
    T.StructField("amount", T.LongType()),
    T.StructField("ref_no", T.StringType()),
])

# The partition column `move_month` is added when a table is landed.
MOVEMENT_LANDED = T.StructType(
    MOVEMENT.fields + [T.StructField("move_month", T.StringType())])

SEARCH_COLS = MOVEMENT.fieldNames()
SHIPMENT_COLS = [c for c in SEARCH_COLS if c not in ("move_type", "storage_loc")]

SCAN = T.StructType([
    T.StructField("scan_group", T.LongType()),
    T.StructField("scan_no", T.IntegerType()),
    T.StructField("operator_id", T.LongType()),
    T.StructField("scan_ts", T.TimestampNTZType()),
    T.StructField("raw", T.StringType()),
])

OUTBOUND = "OUTBOUND"
PURCHASE = "PURCHASE"
RETURN = "RETURN"
PLANTS = ["PLANT_0", "PLANT_1", "PLANT_2", "PLANT_3"]
STAGING_LOCATION = "GI-ZONE"

# Labels found in extracts, and the codes used here.
MOVE_TYPE_LABELS = {
    "매입": "PURCHASE",
    "일반 출하": "OUTBOUND",
    "특수 출하": "SPECIAL_OUTBOUND",
    "출하 취소": "OUTBOUND_CANCEL",
    "이월 매출": "CARRIED_SALES",
    "지점 이동": "PLANT_TRANSFER",
    "일반 반품": "RETURN",
    "RTP": "RTP",
    "POST": "POST",
    "스크랩": "SCRAP",
    "재고보정(-)": "ADJ_MINUS",
    "재고보정(+)": "ADJ_PLUS",
}
MOVE_TYPES = list(MOVE_TYPE_LABELS.values())
MOVEMENT_HEADERS = {
    "Date": "move_date",
    "Time": "move_time",
    "Plant_Code": "plant_code",
    "Move_Desc": "move_type",
    "Storage_Loc": "storage_loc",
    "Partner_Name": "partner_name",
    "Partner_Address": "partner_address",
    "Product_Code": "product_code",
    "Product_Name": "product_name",
    "Batch": "batch",
    "Qty": "qty",
    "Amount": "amount",
    "Ref_No": "ref_no",
}

# Delivery sheet headers and the columns that may hold a customer name.
ORDER_HEADERS = {
    "거래처명": "name",
    "주소": "address",
    "박스수량": "box_qty",
    "봉지수량": "bag_qty",
    "하차시간": "service_time",
    "오픈시간": "time_window_start",
    "마감시간": "time_window_end",
    "비고": "memo",
    "좌표": "coord",
}
VEHICLE_HEADERS = {"차량명": "vehicle_name", "출발지": "start_coord", "연비": "efficiency"}
NAME_COLUMNS = ["name", "Name", "상호명", "거래처명", "장소명", "이름", "고객명"]

# Dispatch parameters.
FLEET_SIZE = 11
ORDERS_PER_DAY = 240
SPEED_KMH = 35.0
SERVICE_MIN = 5.0
DAY_START_HOUR = 9
FUEL_PRICE = 1700
DEFAULT_EFFICIENCY = 9.5
DEFAULT_START = (35.1795543, 129.0756416)  # lat, lon
BOX_LOAD = 1.0
BAG_LOAD = 0.2
PAIR_GAP_MIN = 20.0
FLEET_GAP_MIN = 30.0
TRANSFER_MAX_KM = 15.0

# Geocoding outcome labels.
NO_ADDRESS = "NO_ADDRESS"
NOT_FOUND = "NOT_FOUND"
UNASSIGNED = "UNASSIGNED"
