"""Canonical table layouts as DDL."""

OBSERVATION = "series_id string, pos long, ts_ms long, y double, capacity double, floor double, regressors map<string,double>, conditions map<string,boolean>"
MODEL = (
    "series_id string, model_kind string, growth string, scaling string, y_offset double, y_scale double, time_origin long, time_scale long, k double, m double, sigma double, "
    "has_floor boolean, changepoints_ms array<long>, deltas array<double>, "
    "seasonalities array<struct<name:string,period_days:double,fourier_order:int,prior_scale:double,mode:string,condition:string,coef:array<double>>>, "
    "events array<struct<name:string,epoch_day:int,offset:int,mode:string,coef:double>>, "
    "regressors array<struct<name:string,prior_scale:double,mode:string,transform:string,mean:double,sd:double,coef:double>>, "
    "fit_summary struct<method:string,algorithm:string,termination:string,iterations:int,objective:double,stationarity:double,n:int>, "
    "draws array<struct<chain:int,draw:int,k:double,m:double,sigma:double,deltas:array<double>,beta:array<double>>>, "
    "diagnostics array<struct<name:string,rhat:double,bulk_ess:double,tail_ess:double>>, "
    "country struct<country:string,coverage:string,conflicts:array<string>>"
)
EVENT = "name string, date date, epoch_day int, lower_window int, upper_window int, prior_scale double"
CALENDAR = "country string, year int, epoch_day int, name string"
CV_ROW = "series_id string, fold int, cutoff_ms long, ts_ms long, horizon_ms long, actual double, predicted double, lower double, upper double"
INTERVAL = "series_id string, pos long, ts_ms long, trend_lower double, trend_upper double, value_lower double, value_upper double"
SAMPLE = "series_id string, pos long, ts_ms long, sample int, trend double, value double"
