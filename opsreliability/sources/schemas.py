"""Fixed input layouts."""

# Columns of the public on-time performance file, in file order, with their types.
RAW_COLUMNS = {
    "FlightDate": "date",
    "Reporting_Airline": "string",
    "Tail_Number": "string",
    "Flight_Number_Reporting_Airline": "string",
    "Origin": "string",
    "OriginCityName": "string",
    "OriginState": "string",
    "Dest": "string",
    "DestCityName": "string",
    "DestState": "string",
    "CRSDepTime": "string",
    "DepTime": "string",
    "DepDelay": "double",
    "DepDel15": "double",
    "TaxiOut": "double",
    "TaxiIn": "double",
    "CRSArrTime": "string",
    "ArrTime": "string",
    "ArrDelay": "double",
    "ArrDel15": "double",
    "Cancelled": "double",
    "CancellationCode": "string",
    "Diverted": "double",
    "CRSElapsedTime": "double",
    "ActualElapsedTime": "double",
    "AirTime": "double",
    "Distance": "double",
    "CarrierDelay": "double",
    "WeatherDelay": "double",
    "NASDelay": "double",
    "SecurityDelay": "double",
    "LateAircraftDelay": "double",
}

# Cause columns of a staged leg.
CAUSES = ["carrier_delay_min", "weather_delay_min", "nas_delay_min", "security_delay_min",
          "late_aircraft_delay_min"]

# Cancellation code letters.
CANCELLATION_REASONS = {"A": "Carrier", "B": "Weather", "C": "National Air System",
                        "D": "Security"}
