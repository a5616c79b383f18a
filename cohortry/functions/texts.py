"""The texts of labels and advice in result tables, which must read the same for every user."""

# missing share below 5 %, below 20 %, above
MISSING_ADVICE = ("KNN Imputation (preserves relationships)", "KNN Imputation or Multiple Imputation",
                  "Consider dropping or separate 'Unknown' category")
# numeric columns with two, few, many values
NUMERIC_TYPES = ("Binary", "Discrete", "Continuous")
# text columns with few, medium, many values
TEXT_TYPES = ("Categorical (Low)", "Categorical (Medium)", "Categorical (High)")
ENCODING_ADVICE = {
    "Continuous": "None (RobustScaler for normalization)",
    "Discrete": "None (keep as numeric)",
    "Binary": "None (already 0/1)",
    "Few levels": "One-Hot Encoding (drop='first')",
    "Many levels": "Target/Frequency Encoding",
}
# class ratio below 3, below 10, above
SEVERITY = ("Mild", "Moderate", "Severe")
BALANCE_ADVICE = ("Standard cross-validation sufficient", "Use stratified sampling + class weights",
                  "Use cost-sensitive learning (scale_pos_weight) + stratified CV")
# normal, strongly skewed, otherwise
SCALER_ADVICE = ("StandardScaler (data is normally distributed)", "RobustScaler or Log Transform (highly skewed)",
                 "RobustScaler (not normal, use median/IQR)")
LARGE_TEST, SMALL_TEST = "D'Agostino", "Shapiro-Wilk"
RISK_LEVELS = ("LOW", "MODERATE", "HIGH", "CRITICAL")
CONFIDENCE = ("High", "Moderate", "Low")
STRENGTH = ("Strong", "Moderate", "Weak")
EFFECT = ("RAISES", "LOWERS", "MINIMAL")
ALERT_TEXT = (
    "CRITICAL ALERT: Patient has extremely high stroke risk (>80%). "
    "Immediate clinical evaluation recommended."
)
RISK_PREFIX = "Stroke Risk: "
