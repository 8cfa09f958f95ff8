"""Readers of the instruments' files, and storage of recordings."""

from thermaline.sources.files import Recording, external_series, time_columns
from thermaline.sources.store import load, save
from thermaline.sources.text import read_sensornet, read_traces
from thermaline.sources.binary import read_sensortran
from thermaline.sources.xml import read_apsensing, read_silixa

__all__ = ["Recording", "external_series", "load", "read_apsensing", "read_sensornet", "read_sensortran", "read_silixa", "read_traces", "save", "time_columns"]
