"""The New York area mapping as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Area and the merged area it is reported under, by borough. Areas not named keep
# their own name. "South Slope" and "Richmondtown" stand as the reports have always shown them.
NEW_YORK = """
Baychester = Eastchester-Edenwald-Baychester
Eastchester = Eastchester-Edenwald-Baychester
Edenwald = Eastchester-Edenwald-Baychester
Kingsbridge = Kingsbridge-Marble Hill
Mott Haven = Mott Haven-Port Morris
Port Morris = Mott Haven-Port Morris
Mount Eden = Mount Eden-Claremont(West)
Claremont Village = Mount Eden-Claremont(West)
Bronxdale = Bronx Park
Castle Hill = Castle Hill-Unionport
Concourse = Concourse-Concourse Village
Concourse Village = Concourse-Concourse Village
Pelham Bay = Pelham Bay-Country Club-City Island
Country Club = Pelham Bay-Country Club-City Island
City Island = Pelham Bay-Country Club-City Island
Van Nest = Pelham Parkway-Van Nest
Riverdale = Riverdale-Spuyten Duyvil
Spuyten Duyvil = Riverdale-Spuyten Duyvil
Soundview = Soundview-Clason Point
Clason Point = Soundview-Clason Point
Throgs Neck = Throgs Neck-Schuylerville
Schuylerville = Throgs Neck-Schuylerville
University Heights = University Heights (South)-Morris Heights
Morris Heights = University Heights (South)-Morris Heights
Wakefield = Wakefield-Woodlawn
Woodlawn = Wakefield-Woodlawn
Williamsbridge = Williamsbridge-Olinville
Olinville = Williamsbridge-Olinville
Bedford-Stuyvesant = Bedford-Stuyvesant (East)
Bushwick = Bushwick (West)
Carroll Gardens = Carroll Gardens-Cobble Hill-Gowanus-Red Hook
Cobble Hill = Carroll Gardens-Cobble Hill-Gowanus-Red Hook
Gowanus = Carroll Gardens-Cobble Hill-Gowanus-Red Hook
Red Hook = Carroll Gardens-Cobble Hill-Gowanus-Red Hook
Coney Island = Coney Island-Sea Gate
Sea Gate = Coney Island-Sea Gate
Crown Heights = Crown Heights (North)
Downtown Brooklyn = Downtown Brooklyn-DUMBO-Boerum Hill
DUMBO = Downtown Brooklyn-DUMBO-Boerum Hill
Boerum Hill = Downtown Brooklyn-DUMBO-Boerum Hill
East Flatbush = East Flatbush-Erasmus
East New York = East New York-City Line
Gravesend = Gravesend (South)
Bergen Beach = Marine Park-Mill Basin-Bergen Beach
Mill Basin = Marine Park-Mill Basin-Bergen Beach
Prospect Lefferts Gardens = Prospect Lefferts Gardens-Wingate
Sheepshead Bay = Sheepshead Bay-Manhattan Beach-Gerritsen Beach
Manhattan Beach = Sheepshead Bay-Manhattan Beach-Gerritsen Beach
Gerritsen Beach = Sheepshead Bay-Manhattan Beach-Gerritsen Beach
Williamsburg = South Williamsburg
Sunset Park = Sunset Park (Central)
Windsor Terrace = Windsor Terrace-South Slope
South Slope = Williamsbridge-Olinville
Chelsea = Chelsea-Hudson Yards
Chinatown = Chinatown-Two Bridges
Two Bridges = Chinatown-Two Bridges
East Harlem = East Harlem (North)
Financial District = Financial District-Battery Park City
Battery Park City = Financial District-Battery Park City
Harlem = Harlem (North)
Flatiron District = Midtown South-Flatiron-Union Square
Midtown = Midtown-Times Square
Murray Hill = Murray Hill-Kips Bay
Kips Bay = Murray Hill-Kips Bay
SoHo = SoHo-Little Italy-Hudson Square
Little Italy = SoHo-Little Italy-Hudson Square
Stuyvesant Town = Stuyvesant Peter Cooper Village
Tribeca = Tribeca-Civic Center
Civic Center = Tribeca-Civic Center
Upper East Side = Upper East Side-Lenox Hill-Roosevelt Island
Roosevelt Island = Upper East Side-Lenox Hill-Roosevelt Island
Upper West Side = Upper West Side (Central)
Washington Heights = Washington Heights (South)
Astoria = Astoria (North)-Ditmars-Steinway
Ditmars Steinway = Astoria (North)-Ditmars-Steinway
Breezy Point = Breezy Point-Belle Harbor-Rockaway Park-Broad Channel
Belle Harbor = Breezy Point-Belle Harbor-Rockaway Park-Broad Channel
Douglaston = Douglaston-Little Neck
Little Neck = Douglaston-Little Neck
Flushing = Flushing-Willets Point
Fresh Meadows = Fresh Meadows-Utopia
Howard Beach = Howard Beach-Lindenwood
Jamaica Estates = Jamaica Estates-Holliswood
Holliswood = Jamaica Estates-Holliswood
Jamaica Hills = Jamaica Hills-Briarwood
Briarwood = Jamaica Hills-Briarwood
Long Island City = Long Island City-Hunters Point
Hollis = Oakland Gardens-Hollis Hills
Rockaway Beach = Rockaway Beach-Arverne-Edgemere
Arverne = Rockaway Beach-Arverne-Edgemere
Edgemere = Rockaway Beach-Arverne-Edgemere
Springfield Gardens = Springfield Gardens (South)-Brookville
Whitestone = Whitestone-Beechhurst
Huguenot = Annadale-Huguenot-Prince's Bay-Woodrow
Prince's Bay = Annadale-Huguenot-Prince's Bay-Woodrow
Woodrow = Annadale-Huguenot-Prince's Bay-Woodrow
Arden Heights = Arden Heights-Rossville
Rossville = Arden Heights-Rossville
Arrochar = Grasmere-Arrochar-South Beach-Dongan Hills
Dongan Hills = Grasmere-Arrochar-South Beach-Dongan Hills
South Beach = Grasmere-Arrochar-South Beach-Dongan Hills
Great Kills = Great Kills-Eltingville
Eltingville Kills = Great Kills-Eltingville
Graniteville = Mariner's Harbor-Arlington-Graniteville
Mariners Harbor = Mariner's Harbor-Arlington-Graniteville
New Dorp = New Dorp-Midland Beach
Midland Beach = New Dorp-Midland Beach
New Springville = New Springville-Willowbrook-Bulls Head-Travis
Bull's Head = New Springville-Willowbrook-Bulls Head-Travis
Oakwood = Oakwood-Richmondtown
Richmondtown = Richmondtown
Rosebank = Rosebank-Shore Acres-Park Hill
Shore Acres = Rosebank-Shore Acres-Park Hill
New Brighton = St. George-New Brighton
St. George = St. George-New Brighton
Todt Hill = Todt Hill-Emerson Hill-Lighthouse Hill-Manor Heights
Emerson Hill = Todt Hill-Emerson Hill-Lighthouse Hill-Manor Heights
Lighthouse Hill = Todt Hill-Emerson Hill-Lighthouse Hill-Manor Heights
Tompkinsville = Tompkinsville-Stapleton-Clifton-Fox Hills
Stapleton = Tompkinsville-Stapleton-Clifton-Fox Hills
Clifton = Tompkinsville-Stapleton-Clifton-Fox Hills
West Brighton = West New Brighton-Silver Lake-Grymes Hill
Silver Lake = West New Brighton-Silver Lake-Grymes Hill
Grymes Hill = West New Brighton-Silver Lake-Grymes Hill
Westerleigh = Westerleigh-Castleton Corners
"""


def new_york_areas(spark: SparkSession) -> DataFrame:
    """``(area, merged_area)``, one row for each mapped area."""
    pairs = [tuple(line.split(" = ")) for line in NEW_YORK.strip().splitlines()]
    return spark.createDataFrame(pairs, "area string, merged_area string")
