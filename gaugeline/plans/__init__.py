

from gaugeline.plans import catalogue as catalogue
from gaugeline.plans import streams as streams
from gaugeline.plans import grouped as grouped
from gaugeline.plans import windows as windows
from gaugeline.plans import entry_points as entry_points
