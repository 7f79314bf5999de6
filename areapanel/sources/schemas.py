"""Declared schemas of the known source files, as DDL text; nothing is inferred at read time."""

from __future__ import annotations

VIOLENT_EVENTS = (
    "CMPLNT_NUM string, CMPLNT_FR_DT string, CMPLNT_TO_DT string, RPT_DT string, KY_CD int, OFNS_DESC string, "
    "CRM_ATPT_CPTD_CD string, BORO_NM string, LAT_TRIM double, LON_TRIM double, LATITUDE double, LONGITUDE double, "
    "`Zip Code` int")
VIOLENT_CODES = "KY_CD int"
PERMIT_ISSUANCE = (
    "`Job #` long, `Job doc. #` int, `Job Type` string, `Zip Code` double, `Filing Date` string, LATITUDE double, "
    "LONGITUDE double")
JOB_FILINGS = (
    "`House #` string, `Street Name` string, Borough string, `Job Type` string, `Pre- Filing Date` string, "
    "`Existing Occupancy` string, `Proposed Occupancy` string")
INSPECTIONS = (
    "CAMIS long, DBA string, ZIPCODE double, `INSPECTION DATE` string, `CUISINE DESCRIPTION` string, "
    "`INSPECTION TYPE` string")
STATIONS = (
    "`Station ID` int, `Complex ID` int, `GTFS Stop ID` string, Division string, Line string, `Stop Name` string, "
    "Borough string, `Daytime Routes` string, Structure string, `GTFS Latitude` double, `GTFS Longitude` double, "
    "`Zip Code` string")
PRICE_YEARLY = (
    "Year int, `ZIP Code` int, Zillow_value double, ZillowAdj double, Zillow_value2 double, ZillowAdj2 double")
PERMIT_YEARLY = ("`Zip Code` int, `Filing Year` int, `Job Type` string, Count int")
CRIME_YEARLY = ("Zip_Code int, YEAR int, CRIME_COUNT int")
CRIMES_YEAR = ("LAT_TRIM double, LON_TRIM double, `Zip Code` int, crime_count int")
PERMITS_YEAR = (
    "year int, job_type string, zipcode int, LATITUDE double, LONGITUDE double, num_permits int")
BBOX = ("`Zip Code` int, maxlat double, maxlon double, minlat double, minlon double")
SHOPS = ("index int, ZIPCODE int, `2013` int, `2014` int, `2015` int, `2016` int, `2017` int")
ZIP_NAMES = ("ZIP int, BORO string, NEIGHBORHOOD string, NAME string, WIKILINK string")
NEIGHBORHOOD_ZIPS = (
    "Borough string, Neighborhood string, `Primary ZIP` int, `All ZIPs` string, `Wikipedia Scrape` string")
FORECAST = ("ZIP int, Year int, y_sim double, alpha_pred double, beta_pred double")
PANEL = (
    "ZIP int, Year int, Borough string, Neighborhood string, LandSqMile double, Latitude double, Longitude double, "
    "AGI double, AGIadj2015 double, Zillow_value double, Zillow_value2 double, ZillowAdj double, ZillowAdj2 double, "
    "adjacentZIP string, AdjacentIncome double, AdjacentZillow2 double, Proximity double, `Bordering Water` string, "
    "`Number of Subway Stations in ZIP` double, `Number of Subway Lines Serving ZIP` double, `Number of Parks` int, "
    "`Number of Playgrounds` int, `Park Acreage` double, A1 int, A2 int, DM int, NB int, CRIME_COUNT int")

# One page of place results as the service returns it.
PLACE_PAGE = (
    "status string, results array<struct<place_id: string, formatted_address: string, name: string, "
    "types: array<string>, geometry: struct<location: struct<lat: double, lng: double>>>>")

# A feature collection; only the properties are typed further by the caller.
FEATURES = (
    "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>")

# Names under which the area and year keys occur in the source files; all become area and year.
AREA_NAMES = ("ZIP", "ZIP Code", "Zip Code", "Zip_Code", "ZIPCODE", "zipcode", "RegionName", "postalCode")
YEAR_NAMES = ("Year", "YEAR", "Filing Year", "year")
