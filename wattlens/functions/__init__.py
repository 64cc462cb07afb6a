from wattlens.functions.columns import (  # noqa: F401
    clip, clip100, col_or, num, ratio, risk_color, risk_level, tariff, unit_level, weather_class,
)
