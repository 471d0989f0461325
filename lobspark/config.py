"""Constants of the market data: sessions, horizons, renames. Fixed values."""

TICK = 0.01
BUCKET = 3
MORNING_CLOSE, AFTERNOON_OPEN, AFTERNOON_CLOSE = 41400, 46800, 54000
TRADING_HOURS = ("09:30:00", "15:00:00")
#: Forward-return horizons in rows of the grid.
HORIZONS = {"ret_15s": 5, "ret_30s": 10, "ret_60s": 20, "ret_180s": 60, "ret_300s": 100}
MIN_STOCKS = 10
EPS = 1e-8
LEVELS = 10
PCA_MIN_STOCKS = 20
MOMENT_ROWS, MOMENT_MIN_ROWS = 300, 30
EMA_SPAN = 20
WIDE_LIMIT_PREFIXES = ("688", "300", "301")
SNAP_REQUIRED = ("UpdateTime", "SecurityID", "BidPrice1", "AskPrice1", *(f"BidVolume{i}" for i in range(1, 6)), *(f"AskVolume{i}" for i in range(1, 6)))
#: Shenzhen snapshot names and the unified ones.
SZ_SNAP_NAMES = {"TotalBidQty": "TotalBidVol", "TotalOfferQty": "TotalAskVol", "TurnNum": "TradNumber", "Volume": "TradVolume"}
SECONDARY_TEXT = ("UpdateTime", "SecurityID", "TradingPhaseCode", "date")
EXECUTED = 70
SIDES, ORDER_KINDS = {49: "B", 50: "S"}, {49: "A", 50: "D"}
EMBARGO_DAYS = 5
