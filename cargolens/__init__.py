"""cargolens: shipment-risk analytics as lazy Spark DataFrame operators."""
