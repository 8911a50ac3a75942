"""All registered queries."""

from tremora.plans import catalogue_panel  # noqa: F401
from tremora.plans import catalogue_network  # noqa: F401
from tremora.plans.catalogue_network import flagship  # noqa: F401
from tremora.plans import catalogue_inference  # noqa: F401
from tremora.plans import catalogue_models  # noqa: F401
from tremora.plans import catalogue_pipeline  # noqa: F401
