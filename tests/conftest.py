import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from opsreliability.session import build_session  # noqa: E402
from opsreliability.sources.schemas import RAW_COLUMNS  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", "local[4]", 4, spark__driver__memory="6g",
                      spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


GOOD = {"FlightDate": "2026-01-05", "Reporting_Airline": "AA", "Tail_Number": "N1AA",
        "Flight_Number_Reporting_Airline": "100", "Origin": "ORD", "OriginCityName": "Chicago, IL",
        "OriginState": "IL", "Dest": "LGA", "DestCityName": "New York, NY", "DestState": "NY",
        "CRSDepTime": "1730", "DepTime": "1740", "DepDelay": "10", "DepDel15": "0", "TaxiOut": "15",
        "TaxiIn": "6", "CRSArrTime": "2045", "ArrTime": "2105", "ArrDelay": "20", "ArrDel15": "1",
        "Cancelled": "0", "CancellationCode": "", "Diverted": "0", "CRSElapsedTime": "135",
        "ActualElapsedTime": "145", "AirTime": "124", "Distance": "733", "CarrierDelay": "20",
        "WeatherDelay": "0", "NASDelay": "0", "SecurityDelay": "0", "LateAircraftDelay": "0"}
GONE = {"Cancelled": "1", "CancellationCode": "B", "DepTime": "", "DepDelay": "", "DepDel15": "",
        "TaxiOut": "", "TaxiIn": "", "ArrTime": "", "ArrDelay": "", "ArrDel15": "", "Tail_Number": "",
        "CarrierDelay": "", "WeatherDelay": "", "NASDelay": "", "SecurityDelay": "",
        "LateAircraftDelay": "", "ActualElapsedTime": "", "AirTime": ""}
CASES = {
    "good": {}, "midnight": {"CRSDepTime": "2400", "Flight_Number_Reporting_Airline": "101"},
    "padded": {"Reporting_Airline": " dl ", "Origin": "atl ", "Flight_Number_Reporting_Airline": " 7 "},
    "blank_tail": {"Tail_Number": "  ", "Flight_Number_Reporting_Airline": "102"},
    "gone": {**GONE, "Flight_Number_Reporting_Airline": "103"},
    "diverted": {"Diverted": "1", "ArrDelay": "", "ArrDel15": "",
                 "Flight_Number_Reporting_Airline": "104"},
    "zero_block": {"CRSElapsedTime": "0"}, "no_block": {"CRSElapsedTime": ""},
    "bad_distance": {"Distance": "-1"}, "no_origin": {"Origin": ""},
    "bad_time": {"CRSDepTime": "12a4", "Flight_Number_Reporting_Airline": "105"},
}


def write_raw(path, cases):
    """Raw CSV with the trailing comma of the public files."""
    os.makedirs(path)
    with open(os.path.join(path, "part.csv"), "w") as f:
        f.write(",".join(f'"{c}"' for c in RAW_COLUMNS) + ",\n")
        for change in cases:
            row = {**GOOD, **change}
            f.write(",".join(f'"{row[c]}"' if row[c] else "" for c in RAW_COLUMNS) + ",\n")
    return str(path)


@pytest.fixture(scope="session")
def raw(spark, tmp_path_factory):
    from opsreliability.sources.readers import scan_csv
    path = write_raw(tmp_path_factory.mktemp("raw") / "csv", CASES.values())
    return scan_csv(spark, path, RAW_COLUMNS)
