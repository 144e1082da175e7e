"""Column names, types and default parameters.

Every literal in this module is a fixed value: results depend on it.
"""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "municipio"
TIME = "data_hora"

# --- fixed values: raw file layout -----------------------------------------
RAW_SEP = ";"
RAW_ENCODING = "ISO-8859-1"
RAW_DATE = "Data"
RAW_HOUR = "Hora UTC"

# --- fixed values: raw header -> column name ---------------------------------
RENAME_MAP = {
    "PRECIPITAÇÃO TOTAL, HORÁRIO (mm)": "precipitacao_total_mm",
    "PRESSAO ATMOSFERICA AO NIVEL DA ESTACAO, HORARIA (mB)": "pressao_atm_estacao_mb",
    "PRESSÃO ATMOSFERICA MAX.NA HORA ANT. (AUT) (mB)": "pressao_atm_max_mb",
    "PRESSÃO ATMOSFERICA MIN. NA HORA ANT. (AUT) (mB)": "pressao_atm_min_mb",
    "RADIACAO GLOBAL (Kj/m²)": "radiacao_global_kj_m2",
    "TEMPERATURA DO AR - BULBO SECO, HORARIA (°C)": "temp_ar_c",
    "TEMPERATURA DO PONTO DE ORVALHO (°C)": "temp_ponto_orvalho_c",
    "TEMPERATURA MÁXIMA NA HORA ANT. (AUT) (°C)": "temp_max_c",
    "TEMPERATURA MÍNIMA NA HORA ANT. (AUT) (°C)": "temp_min_c",
    "TEMPERATURA ORVALHO MAX. NA HORA ANT. (AUT) (°C)": "temp_orvalho_max_c",
    "TEMPERATURA ORVALHO MIN. NA HORA ANT. (AUT) (°C)": "temp_orvalho_min_c",
    "UMIDADE REL. MAX. NA HORA ANT. (AUT) (%)": "umidade_rel_max_percent",
    "UMIDADE REL. MIN. NA HORA ANT. (AUT) (%)": "umidade_rel_min_percent",
    "UMIDADE RELATIVA DO AR, HORARIA (%)": "umidade_rel_ar_percent",
    "VENTO, DIREÇÃO HORARIA (gr) (° (gr))": "vento_direcao_graus",
    "VENTO, RAJADA MAXIMA (m/s)": "vento_rajada_ms",
    "VENTO, VELOCIDADE HORARIA (m/s)": "vento_vel_ms",
    "DATA_HORA": "data_hora",
}
MEASURES = [name for name in RENAME_MAP.values() if name != TIME]

# --- fixed values: station file name ----------------------------------------
STATION_FILE_PATTERN = (
    r"(?i)^INMET_[^_]+_[^_]+_[A-Z0-9]+_(.+?)_"
    r"\d{2}-\d{2}-\d{4}_A_\d{2}-\d{2}-\d{4}\.csv$"
)

# --- fixed values: feature table --------------------------------------------
TARGET_COLUMNS = [
    "temp_ar_c",
    "umidade_rel_ar_percent",
    "pressao_atm_estacao_mb",
    "precipitacao_total_mm",
]
LAG_HOURS = [1, 24]
AVERAGE_HOURS = [6, 12]
FEATURE_COLUMNS = [
    "temp_ar_c",
    "umidade_rel_ar_percent",
    "pressao_atm_estacao_mb",
    "precipitacao_total_mm",
    "hora_sin",
    "hora_cos",
    "temp_lag_1h",
    "temp_lag_24h",
    "temp_ma_6h",
    "temp_ma_12h",
    "pressao_ma_6h",
    "pressao_ma_12h",
    "pressao_tendencia_1h",
    "temp_tendencia_1h",
]
FORECAST_TARGETS = ["temp_ar_c"]
KNOWN_FUTURE = ["hora_sin", "hora_cos"]
GROUP_VALUE = "station_1"

# --- fixed values: names under which a time column may appear ------------------
TIME_CANDIDATES = ["data_hora", "date_hour", "datetime", "timestamp", "time", "date", "data"]

# --- fixed values: horizon buckets (name, first hour, last hour) ----------------
HORIZON_BUCKETS = [("near", 1, 24), ("mid", 25, 72), ("far", 73, 9999)]

# --- fixed values: serving models (key, experiment, type, horizon, length, registry) -
SERVING_MODELS = [
    ("tft_72", "weather_tft_h72", "tft", 72, 168, "weather_forecasting_h72"),
    ("tft_168", "weather_tft_h168", "tft", 168, 336, "weather_forecasting_h168"),
    ("tft_336", "weather_tft_h336", "tft", 336, 504, "weather_forecasting_h336"),
]
HORIZON_LABELS = {72: "3 dias", 168: "7 dias", 336: "14 dias"}

# --- fixed values: day periods (first hour, end hour, label) ---------------------
DAY_PERIODS = {
    "manha": (7, 12, "Manhã (07h–12h)"),
    "tarde": (12, 17, "Tarde (12h–17h)"),
    "noite": (17, 24, "Noite (17h–00h)"),
    "madrugada": (0, 7, "Madrugada (00h–07h)"),
}

# --- fixed values: month names ----------------------------------------------
MONTH_NAMES = {
    1: "janeiro", 2: "fevereiro", 3: "março", 4: "abril",
    5: "maio", 6: "junho", 7: "julho", 8: "agosto",
    9: "setembro", 10: "outubro", 11: "novembro", 12: "dezembro",
}
ANNUAL_NAME = "anual"

# --- fixed values: metric names, in order of preference ------------------------
MAPE_KEYS = ["mape", "val_MAPE", "val_mape", "MAPE", "mape_scaled"]
UNKNOWN = "unknown"

# --- fixed values: histogram edges, limits ----------------------------------
INFERENCE_EDGES = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0]
CHAT_EDGES = [0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0]
TOOL_EDGES = [0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0]
CACHE_TTL_SECONDS = 3600
MAX_MESSAGE_CHARS = 8000
DRIFT_THRESHOLD = 0.3
RETENTION_DAYS = 90
NO_CONTEXT_TEXT = "Nenhum dado histórico encontrado para esse contexto."

CLEAN_SCHEMA = T.StructType(
    [T.StructField(KEY, T.StringType()), T.StructField(TIME, T.TimestampType())]
    + [T.StructField(name, T.DoubleType()) for name in MEASURES]
)

POINTS_SCHEMA = "array<struct<timestamp:string,temp_ar_c:double>>"

# --- fixed values: experiment configuration with its defaults -----------------
EXPERIMENT_SCHEMA = (
    "experiment_name string, run_name string, epochs int, batch_size int, "
    "learning_rate double, weight_decay double, early_stopping_patience int, "
    "checkpoint_dir string, device string, "
    "data struct<parquet_path:string,feature_columns:array<string>,"
    "target_columns:array<string>,sequence_length:int,horizon:int,"
    "train_ratio:double,val_ratio:double>, "
    "model struct<model_type:string,hidden_size:int,num_layers:int,dropout:double,"
    "num_heads:int,ffn_dim:int,attention_head_size:int,hidden_continuous_size:int,"
    "num_stacks:int,num_blocks:int,num_block_layers:int,backcast_loss_ratio:double>, "
    "governance struct<model_name:string,model_version:string,model_type:string,"
    "owner:string,risk_level:string,fairness_checked:boolean,"
    "training_data_version:string,git_sha:string>"
)
EXPERIMENT_CHOICES = {
    "model.model_type": ["lstm", "transformer", "tft", "nbeats"],
    "governance.model_type": ["classification", "regression", "generation"],
    "governance.risk_level": ["low", "medium", "high", "critical"],
}
EXPERIMENT_DEFAULTS = {
    "experiment_name": "weather_forecasting",
    "epochs": 50,
    "batch_size": 64,
    "learning_rate": 1e-3,
    "weight_decay": 1e-4,
    "early_stopping_patience": 7,
    "checkpoint_dir": "artifacts/checkpoints",
    "device": "cpu",
    "data.parquet_path": "data/spec",
    "data.feature_columns": FEATURE_COLUMNS,
    "data.target_columns": FORECAST_TARGETS,
    "data.sequence_length": 24,
    "data.horizon": 1,
    "data.train_ratio": 0.8,
    "data.val_ratio": 0.1,
    "model.model_type": "lstm",
    "model.hidden_size": 128,
    "model.num_layers": 2,
    "model.dropout": 0.1,
    "model.num_heads": 4,
    "model.ffn_dim": 256,
    "model.attention_head_size": 4,
    "model.hidden_continuous_size": 16,
    "model.num_stacks": 30,
    "model.num_blocks": 1,
    "model.num_block_layers": 4,
    "model.backcast_loss_ratio": 0.1,
    "governance.model_name": "weather_forecaster",
    "governance.model_version": "0.1.0",
    "governance.model_type": "regression",
    "governance.risk_level": "medium",
    "governance.fairness_checked": False,
}
