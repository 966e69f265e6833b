"""Readers and writers of feeds, networks, population meshes and facilities."""

from .feed import Feed, read_gtfs, read_gtfs_zip, unzip, write_gtfs, zip_folders
from .files import (
    MissingColumns,
    optional,
    read_facilities,
    read_network,
    read_population,
    read_timetable,
    require,
    write_network,
)
from .star import TABLES, star_feed, star_table

__all__ = [
    "TABLES",
    "Feed",
    "MissingColumns",
    "optional",
    "read_facilities",
    "read_gtfs",
    "read_gtfs_zip",
    "read_network",
    "read_population",
    "read_timetable",
    "require",
    "star_feed",
    "star_table",
    "unzip",
    "write_gtfs",
    "write_network",
    "zip_folders",
]
